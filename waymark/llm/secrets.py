"""Secret scan with multipart credential linking. DataFrame functions only, no shuffle.

Base patterns give spans of their own. Weaker parts (account identifiers, mixed tokens that might be secrets, endpoints)
say little alone: an interval join of the parts of one text, the scope, links parts whose starts lie within `reach` code
points of each other, and a weak part is reported only where complementary parts co-occur:

* a weak secret beside an identifier (an access key id or an account assignment),
* an account assignment beside a secret (a weak, an assigned or a hexadecimal one), and an endpoint beside both an
  identifier and a secret.

The parts of a kind do not overlap and have MIN_PART code points at least, so those that start within reach of a part are
among its PARTS_IN_REACH neighbours on either side in order of start: the join reads slices and is linear in the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns and the least length of what they find (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A shorter match of these could not hold a longer one, so the least length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak patterns.
ACCOUNT = r"""(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"""(?:https?|ftp|ssh|postgres(?:ql)?|mysql|redis|mongodb|amqp|s3)://[^\s"'<>]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
#: In the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_account", "linked_endpoint")
REACH = 200
MIN_PART = 5
BLOCK = 64


def _found(text: str, pattern: str) -> Column:
    """array<struct<gap, len, value>> of the leftmost non-overlapping matches: the text between matches gives their places."""
    p = F.lit(pattern)
    hit = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), F.regexp_extract_all(F.col(text), p, F.lit(0)).alias("value"))
    parts = F.transform(F.filter(hit, lambda x: x["value"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["value"]).alias("len"), x["value"].alias("value")))
    return F.when(F.col(text).rlike(pattern), parts)


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x["gap"] + x["len"])


def _placed(df: DataFrame, name: str) -> DataFrame:
    """Turns the found array `name` into array<struct<start, end, value>>, by sums of blocks and sums within a block."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(name) / BLOCK).cast("int") - 1), lambda b: _sum(F.slice(name, b * BLOCK + 1, BLOCK)))
    before = F.aggregate(F.col("_blocks"), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    df = df.withColumn("_blocks", F.when(F.size(name) > 0, blocks)).withColumn("_before", F.when(F.size("_blocks") > 0, before))

    def place(x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.get("_before", block) + _sum(F.slice(name, block * BLOCK + 1, i - block * BLOCK)) + x["gap"]
        return F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["value"].alias("value"))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return df.withColumn(name, F.coalesce(F.when(F.size(name) > 0, F.transform(name, place)), empty)).drop("_blocks", "_before")


def _part(name: str, role: int) -> Column:
    return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(role).alias("role"), x["end"].alias("end")))


#: Roles of parts in the join.
_ACCESS, _SECRET, _WEAK, _ACCOUNT, _ENDPOINT = range(5)


def _near(i: Column, x: Column, roles: tuple[int, ...], reach: int) -> Column:
    """Whether a part of such a role starts within reach of the i-th part."""
    span = len(("access", "secret", "weak", "account", "endpoint")) * (reach // MIN_PART + 1)
    return F.exists(F.slice("_parts", F.greatest(i - span, F.lit(0)) + 1, F.lit(2 * span + 1)), lambda y: y["role"].isin(*roles) & (F.abs(y["start"] - x["start"]) <= reach))


def _span(kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """For each row of docs: id_col, base and spans (arrays of start, kind, end; by start, then kind as in KINDS), the counts
    n_assign, n_access, n_hex, n_linked (long), base_text and spans_text (kind:start:end joined by commas).

    Places count code points, the end is exclusive. A null text is empty and has no spans; repeated rows get equal rows;
    other columns are ignored; an empty table gives none.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    patterns = {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_account": ACCOUNT, "_endpoint": ENDPOINT}
    df = df.select("_id", "_text", *[_found("_text", p).alias(n) for n, p in patterns.items()])
    complements = F.size("_access") > 0
    for c in ("_account", "_endpoint"):
        complements = complements | (F.size(c) > 0)
    df = df.select("_id", *patterns, F.when(complements, _found("_text", WEAK)).alias("_weak"))
    for name in (*patterns, "_weak"):
        df = _placed(df, name)
    group2 = F.filter("_assign", lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    df = df.withColumn("_assign", group2)
    parts = F.concat(_part("_access", _ACCESS), _part("_assign", _SECRET), _part("_hex", _SECRET), _part("_weak", _WEAK), _part("_account", _ACCOUNT), _part("_endpoint", _ENDPOINT))
    df = df.withColumn("_parts", F.sort_array(parts))

    def linked(x: Column, i: Column) -> Column:
        identifier, secret = _near(i, x, (_ACCESS, _ACCOUNT), reach), _near(i, x, (_SECRET, _WEAK), reach)
        return (
            F.when((x["role"] == _WEAK) & identifier, _span("linked_secret", x))
            .when((x["role"] == _ACCOUNT) & secret, _span("linked_account", x))
            .when((x["role"] == _ENDPOINT) & identifier & secret, _span("linked_endpoint", x))
        )

    df = df.withColumn("_linked", F.when(F.size("_parts") > 1, F.filter(F.transform("_parts", linked), lambda x: x.isNotNull())).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))
    base = F.concat(*[F.transform(f"_{k}", lambda x: _span(k, x)) for k in KINDS[:3]])  # noqa: B023
    df = df.withColumn("base", F.sort_array(base)).withColumn("spans", F.sort_array(F.concat("base", "_linked")))
    return df.select(
        F.col("_id").alias(id_col), "base", "spans",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.size("_linked").cast("long").alias("n_linked"),
        _listed("base").alias("base_text"), _listed("spans").alias("spans_text"),
    )
