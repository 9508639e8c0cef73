"""What statuses and outcomes are called on the pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of statuses and outcomes, and what an unknown one is called.
AVAILABILITY = {
    "available": "Доступно",
    "forbidden": "Запрещено правилами robots.txt",
    "deferred": "Проверка отложена",
    "redirect": "Перенаправление",
    "network_error": "Сетевая ошибка",
    "running": "Проверка не завершена",
}
AVAILABILITY_UNKNOWN = "Неизвестный результат"
RUN_STATUS = {
    "running": "Выполняется",
    "completed": "Завершён",
    "partial": "Завершён частично",
    "deferred": "Отложен",
    "failed": "Ошибка",
    "interrupted": "Прерван",
}
STATUS_UNKNOWN = "Неизвестный статус"
ERROR_OUTCOME = {
    "oversized": "Слишком большая HTML-страница",
    "parse_error": "Ошибка разбора HTML",
    "redirect": "Перенаправление",
    "http_error": "Ошибка HTTP",
    "network_error": "Сетевая ошибка",
    "timeout": "Истекло время ожидания",
}
OUTCOME_UNKNOWN = "Неизвестная ошибка страницы"
NOTIFICATION = {
    "not_applicable": "не требуется",
    "disabled": "выключено",
    "pending": "ожидает отправки",
    "sent": "отправлено",
    "failed": "ошибка отправки",
}
NOTIFICATION_UNKNOWN = "неизвестно"


ENTRY_STATUS = {
    "pending": "Ожидает",
    "running": "Выполняется",
    "completed": "Завершён",
    "partial": "Завершён частично",
    "deferred": "Отложен",
    "failed": "Ошибка",
    "interrupted": "Прерван",
    "missed": "Пропущен",
    "cancelled": "Отменён",
}
FREQUENCY = {"daily": "Ежедневно", "weekly": "Еженедельно"}
#: From Monday on.
WEEKDAYS = ("Понедельник", "Вторник", "Среда", "Четверг", "Пятница", "Суббота", "Воскресенье")


def title(table: dict[str, str], key: Column, unknown: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key], F.lit(unknown))


def weekday_title(day: Column) -> Column:
    """The name of a weekday, 0 being Monday; null for what is none."""
    return F.get(F.array(*map(F.lit, WEEKDAYS)), day)


def count_text(n: Column, one: str, few: str, many: str) -> Column:
    """A count with its noun in the form that the number asks for."""
    tens, ones = n % 100, n % 10
    word = F.when((ones == 1) & (tens != 11), one).when(ones.between(2, 4) & ~tens.between(12, 14), few).otherwise(many)
    return F.concat(n.cast("string"), F.lit(" "), word)


def header_fragment(text: Column) -> Column:
    """Text for a mail's header: control characters as spaces, 200 characters at most."""
    return F.substring(F.regexp_replace(text, r"\p{Cc}", " "), 1, 200)
