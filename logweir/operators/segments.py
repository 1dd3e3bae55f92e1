"""Size-bounded segments of a log: generations, their ages, retention.

The exact rule is sequential: a segment takes rows until one of its byte counters reaches the limit,
and the next row opens a new segment. It is computed here without walking a log in one task:

* a log is cut into *blocks* of consecutive rows of bounded size;
* whatever came before, the first segment start inside a block is one of the rows within one limit
  of the block's first row. For each of these *entries* a block records where its chain of segments
  leaves the block: the byte positions that trigger the next start, and how many starts it made;
* neighbouring blocks are folded into one with the same kind of table, level by level;
* the top is entered with the true state, which is handed down level by level; each block then knows
  its real entry and marks its starts.

The tables shrink by the fan-in per level, so all levels together cost little more than the first.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logweir.operators.joins import is_small
from logweir.operators.positions import DIGIT_BITS, summed_once
from logweir.session import materialize

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN_IN = 16
FOLD_BYTES = 2 << 30       # log bytes the entries folded by one task may stand for
FINE_LIMITS = 16           # a fine block spans this many limits,
FINE_FLOOR = 64 * 1024     # but never less than this many bytes
BLOCK_BYTES = 64 << 20     # and never more than a leaf block, which one task holds: text and JSONL bytes together
BROADCAST_FINE_BLOCKS = 200_000

_TABLE = (
    "sink string, node long, entry_text long, entry_json long, exit_text long, exit_json long, "
    "starts long"
)
_STATE = "owner string, node long, exit_text long, exit_json long, starts long"
_MARKS = "sink string, fine long, first_generation long, cuts array<long>"


def _find(text: np.ndarray, json: np.ndarray, at_text, at_json):
    """Index of the first row at or past either trigger (array or scalar)."""
    return np.minimum(np.searchsorted(text, at_text), np.searchsorted(json, at_json))


def _schema(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.field("element", pa.int64()))}
    return pa.schema([(name, types[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _sorted(rows: pa.Table, order: tuple[str, ...], *others: str) -> list[np.ndarray]:
    """Columns of whole numbers, in the order of the first ones."""
    keys = [rows.column(c).to_numpy() for c in order]
    at = np.lexsort(keys[::-1])
    return [k[at] for k in keys] + [rows.column(c).to_numpy()[at] for c in others]


def _leaf_table(text: np.ndarray, json: np.ndarray, limit: int) -> dict[str, np.ndarray]:
    """Entry table of one block of rows, chains followed for all entries at once by doubling."""
    n = len(text)
    step = _find(text, json, text + limit, json + limit)
    last, starts = np.arange(n), np.ones(n, dtype=np.int64)
    jump = np.append(step, n)
    count = np.append(starts, 0)
    end = np.append(last, n)
    while (jump[:-1] < n).any():
        inside = jump < n
        count = count + np.where(inside, count[jump], 0)
        end = np.where(inside, end[jump], end)
        jump = jump[jump]
    entries = min(n, int(step[0]) + 1)
    final = end[:entries]
    return {
        "entry_text": text[:entries], "entry_json": json[:entries],
        "exit_text": text[final] + limit, "exit_json": json[final] + limit,
        "starts": count[:entries],
    }


def _advance(table: dict[str, np.ndarray], at_text: np.ndarray, at_json: np.ndarray, starts: np.ndarray):
    """Push pending triggers through one child table; those past its rows stay as they are."""
    found = _find(table["entry_text"], table["entry_json"], at_text, at_json)
    hit = found < len(table["starts"])
    row = found[hit]
    at_text, at_json, starts = at_text.copy(), at_json.copy(), starts.copy()
    at_text[hit] = table["exit_text"][row]
    at_json[hit] = table["exit_json"][row]
    starts[hit] += table["starts"][row]
    return at_text, at_json, starts


def _children(tables: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order, rest = ("node", "entry_text", "entry_json"), ("exit_text", "exit_json", "starts")
    node, *columns = _sorted(tables, order, *rest)
    edges = np.flatnonzero(np.diff(node, prepend=node[:1] - 1)).tolist()
    for low, high in zip(edges, [*edges[1:], len(node)], strict=True):
        yield int(node[low]), {n: c[low:high] for n, c in zip((*order[1:], *rest), columns, strict=True)}


def _table(sink: pa.Scalar, node: pa.Scalar, table: dict[str, np.ndarray]) -> pa.Table:
    n = len(table["starts"])
    return pa.table({"sink": pa.repeat(sink, n).cast(pa.string()), "node": pa.repeat(node, n), **table}, schema=_schema(_TABLE))


def _leaf(key: tuple, rows: pa.Table) -> pa.Table:
    text, json = _sorted(rows, ("text_pos", "json_pos"))
    return _table(*key, _leaf_table(text, json, rows.column("max_bytes")[0].as_py()))


def _fold(key: tuple, tables: pa.Table) -> pa.Table:
    """Entry table of a parent from those of its children."""
    limit = tables.column("max_bytes")[0].as_py()
    kept: dict[str, np.ndarray] = {}
    open_until = None
    for _, table in _children(tables):
        if kept:
            kept["exit_text"], kept["exit_json"], kept["starts"] = _advance(
                table, kept["exit_text"], kept["exit_json"], kept["starts"]
            )
        text, json = table["entry_text"], table["entry_json"]
        if open_until is None:
            open_until = (text[0] + limit, json[0] + limit)
            more = True
        if more:
            stop = int(_find(text, json, *open_until))
            more = stop >= len(text)
            kept = {
                c: np.concatenate([kept[c], column[: stop + 1]]) if kept else column[: stop + 1]
                for c, column in table.items()
            }
    return _table(*key, kept)


def _hand_down(key: tuple, tables: pa.Table, state: pa.Table) -> pa.Table:
    """State on entering each child of one parent."""
    at_text, at_json, starts = (
        state.column(c).to_numpy()[:1] for c in ("exit_text", "exit_json", "starts")
    )
    rows = []
    for node, table in _children(tables):
        rows.append((node, int(at_text[0]), int(at_json[0]), int(starts[0])))
        at_text, at_json, starts = _advance(table, at_text, at_json, starts)
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table(
        [pa.repeat(key[0], len(rows)).cast(pa.string()), *[pa.array(c, pa.int64()) for c in columns]], schema=_schema(_STATE)
    )


def _mark(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
    """Generation at the start of every fine block of a leaf, and the cuts inside it."""
    shape = _schema(_MARKS)
    if not rows.num_rows:
        return shape.empty_table()
    text, json, fine = _sorted(rows, ("text_pos", "json_pos"), "fine")
    limit, n = rows.column("max_bytes")[0].as_py(), len(text)
    step = _find(text, json, text + limit, json + limit)
    at = int(_find(text, json, *(state.column(c)[0].as_py() for c in ("exit_text", "exit_json"))))
    opens = np.zeros(n, dtype=np.int64)
    while at < n:
        opens[at] = 1
        at = int(step[at])
    generation = state.column("starts")[0].as_py() + np.cumsum(opens)
    place = text + json
    first = np.flatnonzero(np.append(True, fine[1:] != fine[:-1]))
    cuts = [
        place[a:b][1:][opens[a:b][1:] == 1]
        for a, b in zip(first, np.append(first[1:], n))
    ]
    return pa.table({
        "sink": pa.repeat(key[0], len(first)).cast(pa.string()), "fine": fine[first], "first_generation": generation[first],
        "cuts": pa.array(cuts, shape.field("cuts").type),
    }, schema=shape)


def exact_cuts(
    rows: DataFrame, carry: DataFrame | None = None, fan_in: int | None = None,
    known: tuple[DataFrame, int | None, int | None] | None = None,
) -> DataFrame:
    """(sink, fine, first_generation, cuts) for rows of bounded logs.

    ``rows`` has sink, text_pos, json_pos, max_bytes, fine and leaf; ``carry`` the state to continue
    from: sink, text_bytes and json_bytes since the last cut, generation. ``known``, where it is at hand
    already: (sink, max_bytes) rows, the last leaf and the largest limit.
    """
    tables = []

    if known:
        limits, depth_of, longest = known
    else:
        limits = rows.groupBy("sink").agg(F.first("max_bytes").alias("max_bytes"))
        depth_of, longest = rows.agg(F.max("leaf"), F.max("max_bytes")).first()
    # A child's table covers at most one limit, so long segments are folded fewer at a time.
    fan_in = fan_in or max(2, min(FAN_IN, FOLD_BYTES // (longest or 1)))
    if depth_of is not None and depth_of > 0:
        level = rows.select("sink", "leaf", "text_pos", "json_pos", "max_bytes").groupBy(
            "sink", "leaf"
        ).applyInArrow(_leaf, _TABLE)
        top = depth_of
        while top > 0:
            tables.append(materialize(level, "segment-level"))
            top //= fan_in
            if top > 0:
                level = (
                    tables[-1].join(F.broadcast(limits), "sink")
                    .withColumn("parent", F.expr(f"node DIV {fan_in}"))
                    .groupBy("sink", "parent").applyInArrow(_fold, _TABLE)
                )

    # The segment open at the start began ``carry`` bytes before position 0.
    opened = limits.withColumn("node", F.lit(0).cast("long"))
    if carry is not None:
        opened = opened.join(F.broadcast(carry), "sink", "left")
        since = [F.coalesce(c, F.lit(0)) for c in ("text_bytes", "json_bytes", "generation")]
    else:
        since = [F.lit(0)] * 3
    # A name of its own keeps the cogroups below from mixing up the two sides.
    state = opened.select(
        F.col("sink").alias("owner"), "node",
        (F.col("max_bytes") - since[0]).cast("long").alias("exit_text"),
        (F.col("max_bytes") - since[1]).cast("long").alias("exit_json"),
        since[2].cast("long").alias("starts"),
    )
    for table in reversed(tables):
        parents = table.withColumn("parent", F.expr(f"node DIV {fan_in}"))
        state = parents.groupBy("sink", "parent").cogroup(
            state.groupBy("owner", "node")
        ).applyInArrow(_hand_down, _STATE)
    return (
        rows.groupBy("sink", "leaf").cogroup(state.groupBy("owner", "node"))
        .applyInArrow(_mark, _MARKS)
    )


def _sizes(df: DataFrame) -> DataFrame:
    """Rows with ``text_bytes`` and ``json_bytes``; a size the caller did not give counts as 0."""
    for name in ("text_bytes", "json_bytes"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0).cast("long"))
    return df


def assign_generations(
    df: DataFrame, max_bytes: int | Column | None = None, carry: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES, fan_in: int | None = None,
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``generation``, the number of the segment a row is written to, per ``sink``.

    ``sums`` names further running sums to add from the same shuffle, such as the position.

    ``df`` has sink, seq and the bytes each row adds to the text and JSONL outputs (``text_bytes``,
    ``json_bytes``). ``max_bytes`` is a number or a per-sink column; null is one endless segment. Rows come out
    in runs of consecutive ``seq``, however large the tables joined to them are, so writers need not sort them.
    A sink that writes neither output never fills a segment, so its rows keep generation 0.
    """
    limit = F.lit(max_bytes) if max_bytes is None or isinstance(max_bytes, int) else max_bytes
    given = df.columns
    sized = _sizes(df).withColumn("max_bytes", limit.cast("long"))
    sums = sums or {}
    given = [*given, *sums]
    placed, totals = summed_once(
        sized, {"text_pos": "text_bytes", "json_pos": "json_bytes", **sums}, ["sink"], "seq", carried=("max_bytes",)
    )
    place = F.col("text_pos") + F.col("json_pos")
    fine = F.greatest(
        F.least(F.col("max_bytes"), F.lit(block_bytes)) * FINE_LIMITS, F.lit(FINE_FLOOR)
    )
    fine = F.least(fine, F.greatest(F.lit(block_bytes), F.lit(FINE_FLOOR)))
    fines_per_leaf = F.greatest(F.lit(1).cast("long"), F.lit(block_bytes).cast("long") / fine)
    cut_rows = placed.withColumn("fine", F.floor(place / fine)).withColumn(
        "_leaf", F.floor(F.col("fine") / F.floor(fines_per_leaf))
    )
    # A sink without outputs stays at byte 0: its rows open no segment and would all be one block.
    bounded = cut_rows.filter("max_bytes IS NOT NULL AND (text_bytes + json_bytes > 0 OR text_pos + json_pos > 0)").select(
        "sink", "text_pos", "json_pos", "max_bytes", "fine", F.col("_leaf").alias("leaf")
    )
    marks = materialize(
        exact_cuts(bounded, carry, fan_in, _known(df, totals, block_bytes)), "segment-cuts"
    )
    small = is_small(marks, BROADCAST_FINE_BLOCKS)
    if small:
        marks = F.broadcast(marks)
    passed = F.size(F.filter("cuts", lambda cut: cut <= F.col("_place")))
    joined = cut_rows.withColumn("_place", place).join(marks, ["sink", "fine"], "left")
    generation = F.coalesce(F.col("first_generation") + passed, F.lit(0)).cast("long")
    done = joined.select(*given, generation.alias("generation"))
    if totals is None or not small:  # such joins deal the rows out anew
        done = done.repartition("sink", F.shiftright("seq", DIGIT_BITS)).sortWithinPartitions("sink", "seq")
    return done


def _known(df: DataFrame, totals: list[Row] | None, block_bytes: int) -> tuple[DataFrame, int | None, int | None] | None:
    """What :func:`exact_cuts` needs to know about each log, from the totals of its ranges."""
    if totals is None:
        return None
    ends: dict[str, list[int]] = {}
    for row in totals:
        if row["max_bytes"] is not None and (row["_t_text_bytes"] or row["_t_json_bytes"]):
            held = ends.setdefault(row["sink"], [row["max_bytes"], 0])
            held[1] += row["_t_text_bytes"] + row["_t_json_bytes"]
    last = None
    for limit, end in ends.values():
        fine = min(max(min(limit, block_bytes) * FINE_LIMITS, FINE_FLOOR), max(block_bytes, FINE_FLOOR))
        leaf = (end // fine) // math.floor(max(1, block_bytes / fine))
        last = leaf if last is None else max(last, leaf)
    limits = df.sparkSession.createDataFrame([(s, limit) for s, (limit, _) in ends.items()], "sink string, max_bytes long")
    return limits, last, max((limit for limit, _ in ends.values()), default=None)


def latest_generation(df: DataFrame) -> DataFrame:
    """One row per sink: its newest generation."""
    return df.groupBy("sink").agg(F.max("generation").alias("latest"))


def generation_name(df: DataFrame) -> DataFrame:
    """Add ``age``: 0 for the active segment, 1 for the newest closed one, and so on."""
    # One row per sink, so the broadcast does not grow with the log.
    return df.join(F.broadcast(latest_generation(df)), "sink").withColumn(
        "age", F.col("latest") - F.col("generation")
    ).drop("latest")


def retain(df: DataFrame, max_files: int | Column) -> DataFrame:
    """Rows of the active segment and the newest ``max_files`` older ones; 0 keeps everything."""
    limit = F.lit(max_files) if isinstance(max_files, int) else max_files
    aged = generation_name(df)
    return aged.filter((limit == 0) | (F.col("age") <= limit)).drop("age")
