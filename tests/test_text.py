import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.functions import text as X



def test_year(values):
    rows = ["May 5, 2003 or 2004", "12345", "Unknown", "", None, "٢٠٢٠"]
    assert values(X.year_or_self(F.col("v")), rows) == ["2003", "1234", "Unknown", "", None, "٢٠٢٠"]


def test_abbreviate(values):
    rows = ["Limited Edition  418", "Limited Edition\u00a0418", "Open Edition", "Limited Edition", None]
    assert values(X.abbreviate(F.col("v")), rows) == ["LE 418", "LE 418", "Open Edition", "Limited Edition", None]


def test_ascii_id(values):
    rows = ["Children’s", "cloisonné", "ﬁ½²™ß", "plain", "", None, "日本"]
    assert values(X.ascii_id(F.col("v")), rows) == ["Childrens", "cloisonne", "fi122TM", "plain", "", None, ""]


def test_strip(values):
    rows = ["\u00a0\n\ta\x1c ", "a b", " \n ", "", None]
    assert values(X.strip(F.col("v")), rows) == ["a", "a b", "", "", None]


def test_text_lines(values):
    assert values(X.text_lines(F.col("v")), ["a\n\n b \r\nc\x0bd ", "", None]) == [["a", "b", "c", "d"], [], None]


def test_basename(values):
    rows = ["https://h/a/b.jpg?x=1", "https://h/a/", "plain"]
    assert values(X.basename(F.col("v")), rows) == ["b.jpg?x=1", "", "plain"]


def test_price(values):
    rows = ["$19.99 / 3 pieces", "18.99", "Unknown", "$8", None]
    assert values(X.price_or_null(F.col("v")), rows) == [19.99, 18.99, None, 8.0, None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), min_size=20, max_size=60))
def test_ascii_and_strip_equal_python(values, rows):
    rows = [r.replace("\x00", "") for r in rows]
    # Characters newer than Python's Unicode tables may already be known to Arrow.
    rows = [r for r in rows if not any(unicodedata.category(c) in ("Cn", "Cs") for c in r)]
    expected = [unicodedata.normalize("NFKD", r).encode("ascii", "ignore").decode() for r in rows]
    assert values(X.ascii_id(F.col("v")), rows) == expected
    assert values(X.strip(F.col("v")), rows) == [r.strip() for r in rows]
