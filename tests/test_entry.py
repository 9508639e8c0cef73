"""The entry works without the subpackage for training data, and without what that needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {top!r} or name == {top!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len([n for n in q if n.startswith("op") or n == "pipeline"]), len(q) > 100, set(o) <= set(q))
"""


@pytest.mark.parametrize("top", ["pagetide.llm", "corpus_pipeline", "ahocorasick", "xxhash"])
def test_entry_without(top):
    out = subprocess.run([sys.executable, "-c", HIDE.format(top=top)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["0", "True", "True"], out.stderr


def test_intermediates_need_a_shared_folder():
    from pagetide.plans import storage

    class Conf:
        def get(self, *_):
            return None

    class Frame:
        class sparkSession:  # noqa: N801
            conf = Conf()

            class sparkContext:  # noqa: N801
                master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.written(Frame)
