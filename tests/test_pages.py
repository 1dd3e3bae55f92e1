"""Pages and search against plain list slicing, plus the page invariants."""

import pytest
from pyspark.sql import functions as F

from logweir.functions.predicates import LogFilter
from logweir.operators import paging
from logweir.operators.positions import with_positions
from logweir.operators.search import facet, search, search_count, search_numbered
from model import record

LINES = [
    record(f"msg {i} {'needle' if i % 7 == 0 else 'hay'}", ("INFO", "ERROR", "DEBUG")[i % 3],
           ("daemon", "auth")[i % 2])
    for i in range(60)
]
STARTS = [sum(len(x) + 1 for x in LINES[:i]) for i in range(len(LINES) + 1)]
TOTAL = STARTS[-1]
ERRORS = LogFilter.of(sev="err")
IS_ERROR = [i % 3 == 1 for i in range(60)]


@pytest.fixture(scope="module")
def log(spark):
    from logweir.sources.chain import parse_jsonl

    rows = spark.createDataFrame(list(enumerate(LINES)), "seq long, line string")
    return parse_jsonl(with_positions(rows)).cache()


def ids(df):
    return [r.seq for r in df.collect()]


@pytest.mark.parametrize("flt", [None, ERRORS])
@pytest.mark.parametrize("pos", [0, STARTS[20], STARTS[20] + 1, STARTS[59], TOTAL, TOTAL + 50])
@pytest.mark.parametrize("since", [-1, STARTS[25]])
def test_pages(log, flt, pos, since):
    match = [i for i in range(60) if flt is None or IS_ERROR[i]]
    after = [i for i in match if STARTS[i] >= max(pos, since)]
    before = [i for i in match if STARTS[i] < pos and STARTS[i] >= since]
    assert ids(paging.read_forward(log, pos, 5, flt, since)) == after[:5]
    assert ids(paging.read_backward(log, pos, 5, flt, since)) == before[-5:]
    page = paging.forward_summary(log, pos, 5, flt, since).first()
    start, shown = max(pos, since), after[:5]
    assert page.lines == len(shown) and page.total == page.tail_offset == TOTAL
    assert page.first_offset == (STARTS[shown[0]] if shown else start)
    assert page.next_offset == (
        start if not shown else STARTS[shown[-1] + 1] if len(shown) == 5 else TOTAL
    )
    back = paging.backward_summary(log, pos, 5, flt, since).first()
    assert back.next_offset == pos
    assert back.first_offset == (STARTS[before[-5:][0]] if before else pos)


def test_walking_forward_sees_every_match_once(log):
    pos, seen = 0, []
    while True:
        page = ids(paging.read_forward(log, pos, 7, ERRORS))
        if not page:
            break
        seen += page
        pos = paging.forward_summary(log, pos, 7, ERRORS).first().next_offset
    assert seen == [i for i in range(60) if IS_ERROR[i]]


def test_tail_and_edges(log):
    assert ids(paging.tail(log, 4)) == [56, 57, 58, 59]
    assert ids(paging.tail(log, 4, ERRORS, STARTS[52])) == [52, 55, 58]
    assert ids(paging.tail(log, 4, since=TOTAL)) == []
    assert ids(paging.tail(log, 0)) == [] == ids(paging.read_forward(log, 0, 0))
    assert ids(paging.latest_rows(log, 3)) == [57, 58, 59]
    assert ids(paging.show_all(log, ERRORS)) == [i for i in range(60) if IS_ERROR[i]]
    assert ids(paging.context_window(log, STARTS[14], 3)) == [14, 15, 16]
    empty = log.filter("false")
    assert paging.forward_summary(empty, 7, 5).collect() == [(0, 0, 0, 0, 0)]
    assert paging.backward_summary(empty, None, 5).collect() == [(0, 0, 0, 0, 0)]
    assert paging.forward_summary(log, 0, 5, since=TOTAL).collect() == [(0, 0, 0, TOTAL, TOTAL)]
    end = paging.backward_summary(log, None, 2).first()
    assert (end.first_offset, end.next_offset) == (STARTS[58], TOTAL)


def test_search(log):
    hits = [i for i in range(60) if i % 7 == 0]
    assert ids(search(log, "NEEDLE", 4)) == hits[:4]
    assert search_count(log, "needle").first()[0] == len(hits)
    assert ids(search(log, "needle", 100, ERRORS)) == [i for i in hits if IS_ERROR[i]]
    assert search_count(log, "needle", ERRORS, STARTS[20]).first()[0] == len(
        [i for i in hits if IS_ERROR[i] and i >= 20]
    )
    assert ids(search(log, "", 200)) == list(range(60)) and ids(search(log, "zzz")) == []
    assert ids(search(log, "needle", 0)) == []


def test_numbered_search(log):
    rows = search_numbered(log, "needle", 3).orderBy("k").collect()
    assert [r.counter for r in rows] == ["1 / 3 (of 9)", "2 / 3 (of 9)", "3 / 3 (of 9)"]
    assert [(r.next_k, r.prev_k) for r in rows] == [(2, 3), (3, 1), (1, 2)]
    assert search_numbered(log, "needle", 50).filter("k = 9").first().counter == "9 / 9"
    assert search_numbered(log, "zzz").collect() == []


def test_facets(spark):
    rows = spark.createDataFrame([("Auth",), ("auth",), (None,), ("9",), ("99",)], "facility string")
    assert [r.label for r in facet(rows).collect()] == ["auth", "clock", "fac99", "unknown"]
    assert {r.label: r.n for r in facet(rows, counts=True).collect()}["auth"] == 2


def test_page_is_top_k_not_a_sort(log):
    plan = paging.read_forward(log, 100, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
