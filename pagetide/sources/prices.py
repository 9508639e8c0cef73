"""Prices in a page's schema.org markup: JSON-LD first, then microdata."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import NamedTuple

from pagetide.sources.dom import Node

AMOUNT = re.compile(r"\d+(?:[.,]\d+)?").fullmatch
CURRENCY = re.compile(r"[A-Za-z]{3}").fullmatch
#: The types that carry prices, and what each property of theirs states.
TYPES = frozenset(["Offer", "AggregateOffer", "UnitPriceSpecification"])
RANGE = (("lowPrice", "low"), ("highPrice", "high"))


class Price(NamedTuple):
    amount: Decimal
    currency: str | None
    kind: str
    source: str


def amount_of(value) -> Decimal | None:
    """Digits with at most one comma or point; anything else states no amount."""
    if isinstance(value, bool) or not isinstance(value, (str, int, Decimal)):
        return None
    text = str(value).strip()
    return Decimal(text.replace(",", ".")) if AMOUNT(text) else None


def currency_of(value) -> str | None:
    return value.strip().upper() if isinstance(value, str) and CURRENCY(value.strip()) else None


def types_of(value) -> set[str]:
    named = [t for v in (value if isinstance(value, list) else [value]) if isinstance(v, str) for t in v.split()]
    return {re.split(r"[/#]", t.rstrip("/#"))[-1] for t in named} & TYPES


def stated(value) -> bool:
    return value is not None and str(value).strip() != ""


def json_ld(payload) -> list[Price]:
    """A walk over nested entities with a stack. Currency is inherited; a specification counts unless it names a price type or its offer states a price itself."""
    found: list[Price] = []
    stack = [(payload, None, False, False)]
    while stack:
        value, currency, specification, silent = stack.pop()
        if isinstance(value, list):
            stack.extend((v, currency, specification, silent) for v in reversed(value))
            continue
        if not isinstance(value, dict):
            continue
        kinds = types_of(value.get("@type")) | ({"UnitPriceSpecification"} if specification else set())
        currency = currency_of(value.get("priceCurrency")) or currency
        direct = amount_of(value.get("price")) if "Offer" in kinds else None
        if direct is not None:
            found.append(Price(direct, currency, "price", "json-ld"))
        if "AggregateOffer" in kinds:
            found += [Price(a, currency, kind, "json-ld") for name, kind in RANGE if (a := amount_of(value.get(name))) is not None]
        if "UnitPriceSpecification" in kinds and not silent and not stated(value.get("priceType")) and (a := amount_of(value.get("price"))) is not None:
            found.append(Price(a, currency, "price", "json-ld"))
        below = [(v, currency, k == "priceSpecification", k == "priceSpecification" and direct is not None) for k, v in value.items() if k != "@type"]
        stack.extend(reversed(below))
    return found


class Scope:
    """An itemscope with the properties that are its own, and the scopes that are."""

    def __init__(self, node: Node, parent: Scope | None):
        self.node, self.parent = node, parent
        self.kinds = types_of(node.attributes.get("itemtype"))
        self.values: dict[str, str] = {}
        self.scopes: list[tuple[list[str], Scope]] = []

    def value(self, name: str) -> str | None:
        return self.values.get(name)

    def currency(self) -> str | None:
        return currency_of(self.value("priceCurrency"))

    def offer(self) -> Scope | None:
        up = self.parent
        while up and "Offer" not in up.kinds:
            up = up.parent
        return up


def scopes_of(root: Node) -> list[Scope]:
    scopes: list[Scope] = []
    stack: list[tuple[Node, Scope | None]] = [(c, None) for c in reversed(root.children) if isinstance(c, Node)]
    while stack:
        node, above = stack.pop()
        own = Scope(node, above) if "itemscope" in node.attributes else above
        names = node.attributes.get("itemprop", "").split()
        if own is not above:
            scopes.append(own)
            if above and names:
                above.scopes.append((names, own))
        if own and names:
            text = node.attributes["content"] if "content" in node.attributes else " ".join(node.strings())
            for name in names:
                own.values.setdefault(name, text)
        stack.extend((c, own) for c in reversed(node.children) if isinstance(c, Node))
    return scopes


def microdata(root: Node) -> list[Price]:
    found: list[Price] = []
    for s in scopes_of(root):
        if "Offer" in s.kinds:
            if (direct := amount_of(s.value("price"))) is not None:
                found.append(Price(direct, s.currency(), "price", "microdata"))
            else:
                for _, spec in (x for x in s.scopes if "priceSpecification" in x[0]):
                    if not stated(spec.value("priceType")) and (a := amount_of(spec.value("price"))) is not None:
                        found.append(Price(a, spec.currency() or s.currency(), "price", "microdata"))
        if "AggregateOffer" in s.kinds:
            found += [Price(a, s.currency(), kind, "microdata") for name, kind in RANGE if (a := amount_of(s.value(name))) is not None]
        if "UnitPriceSpecification" in s.kinds and not stated(s.value("priceType")):
            offer = s.offer()
            if (offer is None or amount_of(offer.value("price")) is None) and (a := amount_of(s.value("price"))) is not None:
                found.append(Price(a, s.currency() or (offer.currency() if offer else None), "price", "microdata"))
    return found


def prices(root: Node) -> list[Price]:
    """Each kind, amount and currency once, where it is first stated. A script that can't be read states nothing."""
    found: list[Price] = []
    for node in root.elements():
        if node.tag == "script" and node.attributes.get("type", "").casefold() == "application/ld+json":
            try:
                found += json_ld(json.loads("".join(node.strings()), parse_float=Decimal, parse_constant=lambda _: None))
            except (TypeError, ValueError, RecursionError):
                continue
    found += microdata(root)
    once: dict[tuple, Price] = {}
    for p in found:
        once.setdefault((p.kind, p.amount, p.currency), p)
    return list(once.values())
