import pytest

from brindle.llm import queries
from tests.conftest import DATA
from tests.oracle import check, no_pairs

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    check(spark, DATA, name, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, str(DATA)).count() > 0


def test_nothing_else_imports_this_folder():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for p in (root / "brindle").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "brindle.llm" not in p.read_text() and "from .llm" not in p.read_text(), p


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_plan_builds_pairs(spark, name):
    no_pairs(queries.queries()[name](spark, str(DATA)), name)
