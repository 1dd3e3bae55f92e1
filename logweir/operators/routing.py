"""Which message goes where: routing rules to join keys, fan-out to sinks, forwarding, truncation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import fixed
from logweir.operators.joins import BROADCAST_ROWS, join_small

NO_FACILITY = -1
_BLANKS = " \t\r\n\v\f"


def compile_rules(rules: DataFrame, name: str, *carried: str) -> DataFrame:
    """Rules with a ``facility_spec`` to (name, facility_code) rows; a null code accepts everything.

    ``carried`` columns of a rule come along, so that nobody has to join the rules to themselves.

    Names are comma-separated, trimmed and case-insensitive. An absent or empty spec, or ``*``
    anywhere, is the wildcard. A name that is not known before any ``*`` is an error.
    """
    codes = F.create_map(*[F.lit(x) for pair in fixed.FACILITY_CODES.items() for x in pair])
    spec = F.coalesce(F.col("facility_spec"), F.lit(""))
    tokens = F.transform(F.split(spec, ","), lambda t: F.lower(F.btrim(t, F.lit(_BLANKS))))
    star = F.array_position(F.col("_tokens"), F.lit("*"))
    read = F.when(star > 0, F.slice("_tokens", F.lit(1), star - 1)).otherwise(F.col("_tokens"))
    code = lambda t: F.coalesce(
        F.element_at(codes, t),
        F.raise_error(F.concat(F.lit("Unknown facility name: '"), t, F.lit("'"))).cast("int"),
    )
    wildcard = (F.col("facility_spec").isNull()) | (spec == "") | (F.col("_star") > 0)
    return (
        rules.select(name, *carried, "facility_spec", tokens.alias("_tokens"))
        .select(name, *carried, "facility_spec", star.alias("_star"), read.alias("_read"))
        .select(
            name, *carried,
            F.when(spec == "", F.array().cast("array<int>"))
            .otherwise(F.transform("_read", code)).alias("_codes"),
            wildcard.alias("_all"),
        )
        # The check above runs for every rule, so a bad name is found even beside a wildcard.
        .select(name, *carried, F.explode(
            F.when(F.col("_all") & (F.size("_codes") >= 0), F.array(F.lit(None).cast("int")))
            .otherwise(F.array_distinct("_codes"))
        ).alias("facility_code"))
    )


def compile_routes(routes: DataFrame) -> DataFrame:
    """Output rules to (sink, facility_code) rows; see :func:`compile_rules`."""
    return compile_rules(routes, "sink")


def _join_keys(compiled: DataFrame, malformed: Column) -> DataFrame:
    """One row per facility code a rule accepts, so that routing is a plain equi-join.

    A wildcard takes all 24 codes, and the stand-in for "no facility" where malformed messages
    are wanted.
    """
    every = F.sequence(F.lit(0), F.lit(len(fixed.FACILITY_NAMES) - 1))
    some = F.array(F.col("facility_code"))
    with_none = F.when(malformed, F.concat(F.array(F.lit(NO_FACILITY)), every)).otherwise(every)
    accepted = F.when(F.col("facility_code").isNull(), with_none).otherwise(some)
    return compiled.withColumn("_code", F.explode(accepted)).drop("facility_code")


def _with_code(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("_code", F.coalesce("facility_code", F.lit(NO_FACILITY)))


def route(parsed: DataFrame, routes: DataFrame, *carried: str) -> DataFrame:
    """Every message to every sink that accepts it: input columns plus ``sink`` and ``carried``
    columns of its rule, such as the outputs it writes.

    Malformed messages reach only wildcard sinks that keep them.
    """
    return join_small(_with_code(parsed), _route_keys(routes, *carried), ["_code"]).drop("_code")


def _route_keys(routes: DataFrame, *carried: str) -> DataFrame:
    """Join keys of the rules. A sink has one rule: a second one would write every message twice."""
    twice = routes.groupBy("sink").agg(F.count("*").alias("_rules"), *[F.first(c).alias(c) for c in routes.columns if c != "sink"])
    checked = twice.withColumn("sink", F.when(F.col("_rules") == 1, F.col("sink")).otherwise(
        F.raise_error(F.concat(F.lit("More than one rule for sink: '"), F.col("sink"), F.lit("'")))))
    compiled = compile_rules(checked, "sink", "include_malformed", *carried)
    return _join_keys(compiled, F.col("include_malformed")).select("sink", *carried, "_code")


class Router:
    """:func:`route` for many batches: the rules are compiled, and their number is looked at, once."""

    def __init__(self, routes: DataFrame, *carried: str):
        keys = _route_keys(routes, *carried)
        found = keys.limit(BROADCAST_ROWS + 1).collect()
        self.few = len(found) <= BROADCAST_ROWS
        self.keys = routes.sparkSession.createDataFrame(found, keys.schema) if self.few else keys

    def __call__(self, parsed: DataFrame) -> DataFrame:
        coded = _with_code(parsed)
        joined = coded.join(F.broadcast(self.keys), "_code") if self.few else join_small(coded, self.keys, ["_code"])
        return joined.drop("_code")


def truncate_payload(raw: Column, limit: Column | int) -> Column:
    """Payload cut to ``limit`` bytes, the cut marked by a suffix where it fits; 0 is no limit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    size = F.octet_length(raw)
    note = F.concat(F.lit("[TRUNCATED: "), size.cast("string"), F.lit(" bytes]"))
    room = limit - F.octet_length(note)
    marked = F.concat(F.substring(raw, F.lit(1), room), note.cast("binary"))
    return (
        F.when((limit == 0) | (size <= limit), raw)
        .when(room <= 0, F.substring(raw, F.lit(1), limit))
        .otherwise(marked)
    )


def select_forwards(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages each enabled target wants: input columns plus ``target`` and ``max_message_size``.

    Unlike sinks, a wildcard target always takes malformed messages.
    """
    enabled = rules.filter("enabled")
    compiled = compile_rules(enabled, "target", "max_message_size")
    keys = _join_keys(compiled, F.lit(True))
    return join_small(_with_code(parsed), keys, ["_code"]).drop("_code")


def forward(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """What leaves for each target: (target, seq, rcv, src, payload) with payloads cut to size."""
    chosen = select_forwards(parsed, rules)
    limit = F.coalesce("max_message_size", F.lit(2048))
    return chosen.select(
        "target", "seq", "rcv", "src", truncate_payload(F.col("raw"), limit).alias("payload")
    )
