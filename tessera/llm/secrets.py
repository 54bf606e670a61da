"""Secret scans: spans of credentials, and weak parts of one reported where they complement each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import packed
from .spans import find_matches

# The base patterns, their least lengths and their order.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = (
    "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _KEYWORDS) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: kind, pattern, the group that counts, and what that group must match. Plain enough for any regex engine.
BASE = (
    ("assign", _ASSIGN, 1, ("......",)),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, ()),  # runs end where [A-Z0-9] ends, so short ones can't hide longer ones
    ("hex", r"[0-9a-f]{24,}", 0, ()),
)

# Weak parts: alone they are no finding. An identifier says whose credential, a secret what, an endpoint where.
# Repeats are of single characters only: a regex engine takes those in a loop, and each character once, where a
# repeated group would cost a frame of the stack. A run of digits and dots is taken whole; the test finds addresses.
WEAK = (
    ("identifier", r"(?:[Cc]lient|[Uu]ser|[Aa]ccount|[Aa]ccess)[_-]?(?:[Ii]d|[Nn]ame|[Kk]ey)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]+", 0, ()),
    ("material", r"[0-9A-Za-z+/_-]{20,}", 0, ("[0-9]", "[A-Z]", "[a-z]")),
    ("endpoint", r"https?://[^\x20\x09-\x0D\"'<>]+|[0-9](?:[0-9.]*[0-9])?(?::[0-9]+)?", 0, (r"^https?://|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?$",)),
)
KINDS = tuple(k for k, *_ in BASE + WEAK)
ROLES = {"assign": "secret", "hex": "secret", "material": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
#: Roles that make a role's weak part a finding. An endpoint tells something only beside a secret.
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
SCOPE = 200  # code points between two parts of one credential, at most

#: Of a URL: what comes before its host if it names a user, and all up to its query.
_USERINFO, _PLACE = r"^https?://[^/?#]*@", r"^[^?#]*"
_FOUND = "array<struct<start: bigint, rank: int, end: bigint>>"
BLOCK = 1024  # code points of the blocks in which a text's parts are looked up


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))


def _numbered(rank: int):
    """A match with its kind, its number among that kind's, and where the place within it begins and ends."""

    def of(x: Column, k: Column) -> Column:
        low, high = F.lit(0), F.length(x["match"])
        if KINDS[rank] == "endpoint":
            low, high = (F.length(F.regexp_extract(x["match"], p, 0)) for p in (_USERINFO, _PLACE))
        low, high = low.cast("long").alias("low"), high.cast("long").alias("high")
        return F.struct(F.lit(rank).alias("rank"), k.cast("long").alias("k"), x["gap"].alias("gap"), x["len"].alias("len"), low, high, x["ok"].alias("ok"))

    return of


def _parts(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, rank, end, low, high for all matches of all kinds; [low, high) is what a part
    stands for: of an endpoint, its host and path. Rows alike in id and text give one set of parts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [F.transform(find_matches(text, pattern, group, tests), _numbered(rank)) for rank, (_, pattern, group, tests) in enumerate(BASE + WEAK)]
    # matches and key first, once a text; and an outer explode: for an inner one the optimizer searches texts once more
    found = docs.select("doc_id", _key(text).alias("key"), F.concat(*kinds).alias("all")).select("doc_id", "key", F.explode_outer("all").alias("p"))
    found = found.where("p IS NOT NULL").select("doc_id", "key", "p.*").distinct()
    # dealt once, for the windows below and those of secret_spans
    found = found.repartition("doc_id", "key")
    order = W.partitionBy("doc_id", "key", "rank").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).where("ok")
    start = F.col("end") - F.col("len")
    return found.select("doc_id", "key", start.alias("start"), "rank", "end", (start + F.col("low")).alias("low"), (start + F.col("high")).alias("high"))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base and found (arrays of start, rank in KINDS, end in code points, in that order)
    and key, for the rows of docs (doc_id, text; other columns are ignored) in which anything is found.

    Only disjoint parts complement each other. An endpoint stands for its host and path, in which no
    material counts, so a long URL alone is no finding; user names before and queries behind are parts
    of their own.

    base holds the base kinds' spans. found adds the weak parts that have a complementary part, weak
    or not, within scope code points. Parts become rows and an interval join pairs each with its
    nearest complements: within a document in order of position, the furthest end of a role before
    and the next start of a role behind decide, each a running value, so no more rows are made than
    there are parts, work is linear in them but for the sort, and nothing but positions is shuffled.
    A document's parts meet in one task, as its text did.

    Parts are joined by the row's doc_id and text (key), so rows that share a doc_id keep their own
    spans; repeated rows have one result. Null and empty texts have none, of any length are searched
    whole. Of parts at one place, both count. Empty table: no rows.
    """
    parts = _parts(docs)
    names = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    parts = parts.withColumn("role", F.get(names, F.col("rank")))

    # what lies in an endpoint's host or path is part of the endpoint; endpoints don't overlap, so the last one decides
    order = W.partitionBy("doc_id", "key").orderBy("start", F.desc("rank"), "end")
    inside = F.max(F.when(F.col("role") == "endpoint", F.struct("start", "low", "high"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = parts.withColumn("e", inside)
    in_place = (F.col("rank") == KINDS.index("material")) & (F.col("end") > F.col("e.low")) & (F.col("end") <= F.col("e.high"))
    parts = parts.where(~F.coalesce(in_place, F.lit(False))).drop("e")

    # ends come before starts at the same place: a part's start sees all that ended, its end all that is to start
    parts = parts.withColumn("begins", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.when(F.col("begins") == 1, F.col("low")).otherwise(F.col("high")))
    # both frames begin at an end of the order, for running values: what is behind comes first in the reverse
    document = W.partitionBy("doc_id", "key")
    before = document.orderBy("at", "begins", "rank").rowsBetween(W.unboundedPreceding, -1)
    behind = document.orderBy(F.desc("at"), F.desc("begins"), F.desc("rank")).rowsBetween(W.unboundedPreceding, -1)
    ended, begun = (lambda r: F.when((F.col("role") == r) & (F.col("begins") == 0), F.col("at"))), (lambda r: F.when((F.col("role") == r) & (F.col("begins") == 1), F.col("at")))
    gaps = {r: (F.max(ended(r)).over(before), F.min(begun(r)).over(behind)) for r in COMPLEMENTS}
    for r, (end, start) in gaps.items():
        near = F.when(F.col("begins") == 1, F.col("at") - end <= scope).otherwise(start - F.col("at") <= scope)
        parts = parts.withColumn(f"near_{r}", F.coalesce(near, F.lit(False)))
    linked = F.lit(False)
    for r, others in COMPLEMENTS.items():
        for other in others:
            linked = linked | ((F.col("role") == r) & F.col(f"near_{other}"))
    is_base = F.col("rank") < len(BASE)
    span = F.struct("start", "rank", "end")
    return parts.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.when(is_base, span))).alias("base"),
        F.array_sort(F.collect_set(F.when(is_base | linked, span))).alias("found"),
    )


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each row of docs (doc_id, text; other columns are ignored): doc_id, n_assign, n_access,
    n_hex, base_sha256, spans, n_weak. See secret_spans. Rows with null or empty text have no spans;
    repeated rows have equal results, a row each. Empty table: no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), _key(text).alias("key"))
    found = secret_spans(docs, scope)
    same = F.col("rows.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.col("rows.key") == F.col("found.key"))
    none = F.array().cast(_FOUND)
    base, spans = F.coalesce("base", none), F.coalesce("found.found", none)
    counts = [F.size(F.filter(base, _of_rank(r))).cast("long").alias(f"n_{KINDS[r]}") for r in range(len(BASE))]
    return (
        rows.alias("rows")
        .join(found.alias("found"), same, "left")
        .select(
            F.col("rows.doc_id"),
            *counts,
            F.sha2(_named(base), 256).alias("base_sha256"),
            _named(spans).alias("spans"),
            (F.size(spans) - F.size(base)).cast("long").alias("n_weak"),
        )
    )


def redact_secrets(docs: DataFrame, mark: str = "[REDACTED]", scope: int = SCOPE) -> DataFrame:
    """docs with every found span replaced in text by the mark; overlapping spans become one.
    n_chars, where docs has it, is counted anew for changed rows. Rows without spans, with null or empty
    texts among them, are as they were; repeated rows change alike. Empty table: no rows.

    What lies between two marks is put together from blocks of BLOCK code points, cut once a text, so the
    work is linear in the text and its spans."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    spans = secret_spans(docs, scope).where(F.size("found") > 0).select("doc_id", "key", F.explode("found").alias("s")).select("doc_id", "key", "s.start", "s.end")
    order = W.partitionBy("doc_id", "key").orderBy("start", "end")
    spans = spans.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("n", F.sum(F.coalesce(F.col("start") >= F.col("reach"), F.lit(True)).cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = spans.groupBy("doc_id", "key", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (_key(text) == F.col("key"))

    def part(low: Column, high: Column) -> Column:
        """Code points [low, high) of the text."""
        first, last = F.floor(low / BLOCK), F.floor(high / BLOCK)
        inside = lambda b, x, n: F.substring(F.coalesce(F.get("blocks", b), F.lit("")), (x + 1).cast("int"), n.cast("int"))
        between = F.array_join(F.slice("blocks", (first + 2).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int")), "")
        apart = F.concat(inside(first, low % BLOCK, F.lit(BLOCK)), between, inside(last, F.lit(0), high % BLOCK))
        return F.when(first == last, inside(first, low % BLOCK, high - low)).otherwise(apart)

    ahead = lambda k: F.coalesce(F.get("found", k - 1)["end"], F.lit(0).cast("long"))
    pieces = F.transform("found", lambda s, k: F.concat(part(ahead(k), s["start"]), F.lit(mark)))
    rest = part(F.element_at("found", -1)["end"], F.length(text).cast("long"))
    out = packed(docs).join(found, same, "left").select("row", "found", F.when(F.col("found").isNotNull(), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("blocks"))
    out = out.select("row", F.when(F.col("found").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).alias("redacted"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.coalesce("redacted", columns["text"])
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("redacted").isNotNull(), F.length("redacted").cast(kind)).otherwise(columns["n_chars"])
    return out.select(*[x.alias(c) for c, x in columns.items()])


def _oracle() -> str:
    """The same rows in DuckDB's SQL, by positions from gaps and matches, and a plain pairing of parts."""
    selects = []
    for rank, (kind, pattern, group, tests) in enumerate(BASE + WEAK):
        p = "'" + pattern.replace("'", "''") + "'"
        kept = " AND ".join(["true", *(f"regexp_matches(i, '{t}')" for t in tests)])
        low, high = (f"length(regexp_extract(m, '{x}'))" if kind == "endpoint" else y for x, y in ((_USERINFO, "0"), (_PLACE, "length(m)")))
        selects.append(f"""
            SELECT doc_id, {rank} AS rank, stop - length(m) AS start, stop AS "end", stop - length(m) + {low} AS low, stop - length(m) + {high} AS high FROM (
                SELECT doc_id, i, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (
                    SELECT doc_id, unnest(string_split_regex(text, {p})) AS g, unnest(regexp_extract_all(text, {p})) AS m,
                           unnest(regexp_extract_all(text, {p}, {group})) AS i, generate_subscripts(string_split_regex(text, {p}), 1) AS k
                    FROM documents WHERE regexp_matches(text, {p})) WHERE m IS NOT NULL)
            WHERE {kept}""")
    roles = ", ".join(f"({i}, '{k}', '{ROLES[k]}')" for i, k in enumerate(KINDS))
    wanted = ", ".join(f"('{r}', '{o}')" for r, others in COMPLEMENTS.items() for o in others)
    return f"""
        WITH everything AS MATERIALIZED ({" UNION ALL ".join(selects)}),
        parts AS (
            SELECT * FROM everything x WHERE rank <> {KINDS.index("material")} OR NOT EXISTS (
                SELECT 1 FROM everything y WHERE y.doc_id = x.doc_id AND y.rank = {KINDS.index("endpoint")} AND y.start <= x.start AND x."end" > y.low AND x."end" <= y.high)),
        roles(rank, kind, role) AS (VALUES {roles}), wanted(role, other) AS (VALUES {wanted}),
        named AS MATERIALIZED (SELECT p.*, kind, role FROM parts p JOIN roles USING (rank)),
        found AS (
            SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS s FROM named x WHERE rank < {len(BASE)} OR EXISTS (
                SELECT 1 FROM named y JOIN wanted w ON y.role = w.other
                WHERE y.doc_id = x.doc_id AND w.role = x.role AND (y.low - x.high BETWEEN 0 AND {SCOPE} OR x.low - y.high BETWEEN 0 AND {SCOPE}))),
        summed AS (
            SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {r}) AS n_{KINDS[r]}" for r in range(len(BASE)))},
                   count(*) FILTER (rank >= {len(BASE)}) AS n_weak,
                   string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans
            FROM found GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS[: len(BASE)], "weak"))},
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN summed USING (doc_id)"""


ORACLE_SQL = _oracle()
