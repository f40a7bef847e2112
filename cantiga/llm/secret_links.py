"""Secrets in text: single patterns, and credentials linked from several parts.

A credential often comes in parts: an access identifier, a secret, and the
endpoint they are for.  Some parts give themselves away (the *strong* kinds),
others are only words of a suspicious shape (the *weak* kinds).  Identifiers
and secrets of a text are joined where their intervals, widened by a scope,
meet; an endpoint belongs to a linked pair when both of its parts lie in its
scope.  A weak part is reported only when such complementary parts co-occur.

Everything is DataFrame functions.  Texts are scanned where they lie; what is
shuffled are the numbers of the spans found.  The joins meet in bins of a
scope's width, and spans of one kind do not overlap, so that the partners of a
part are bounded by the characters of its scope, however long its text is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cantiga.llm.common import Stored

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


def either_case(word: str) -> str:
    """A pattern for ``word`` with its letters A to Z in either case, whatever the engine folds beyond them."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in word)


def _named(names: str, value: str) -> str:
    """A name, a sign of assignment, and a value in group 2."""
    return rf"""({either_case(names)})["']?\x20*[:=]\x20*["']?({value})"""


def _assigned(characters: str, least: int) -> str:
    return rf"""[:=]\x20*["']?[{characters}]{{{least}}}"""


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: What a span of this kind can be a part of.
    role: str
    weak: bool
    #: Group that must have ``least`` characters, and classes of characters a match must all hold.
    group: int = 0
    least: int = 1
    holds: tuple[str, ...] = ()
    #: What every text with a match that counts has, and is quick to look for.
    sign: str | None = None


#: In the order in which spans of the same start are listed.  Patterns whose matches can be too short are as greedy as
#: without the length, so that what is dropped for its length still uses up its characters.
KINDS = (
    Kind("assign", _named("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), SECRET, False, 2, 12, sign=_assigned("A-Za-z0-9+/_.=-", 12)),
    Kind("access", "AKIA[A-Z0-9]{14,}", IDENTIFIER, False),
    Kind("hex", "[0-9a-f]{16,}", SECRET, False),
    Kind("identifier", _named("access_?key_?id|client_?id|account_?id|user_?name|login", "[A-Za-z0-9@._-]+"), IDENTIFIER, True, 2, 3, sign=_assigned("A-Za-z0-9@._-", 3)),
    Kind("secret", "[A-Za-z0-9+/_-]{32,}", SECRET, True, holds=("[A-Z]", "[a-z]", "[0-9]")),
    Kind("endpoint", "[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:@%-]+", ENDPOINT, True),
)
BASE = tuple(k for k, kind in enumerate(KINDS) if not kind.weak)
#: Characters of a scope on either side of a part.
SCOPE = 256


def _hits(text: Column, k: int) -> Column:
    """Matches of kind ``k`` in order: the characters since the one before, its own, and whether it counts."""
    kind = KINDS[k]
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))

    def hit(x: Column) -> Column:
        counts = F.char_length(x["value"]) >= kind.least
        for held in kind.holds:
            counts = counts & x["value"].rlike(held)
        return F.struct(F.lit(k).alias("kind"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["found"]).alias("n"), counts.alias("counts"))

    rows = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value")), hit)
    # A weak part that is no identifier counts for nothing where there is none.
    return F.when(F.col("identified") & _has(text, kind) if kind.weak and kind.role != IDENTIFIER else _has(text, kind), rows).otherwise(F.array().cast("array<struct<kind:int,gap:int,n:int,counts:boolean>>"))


def _has(text: Column, kind: Kind) -> Column:
    return text.rlike(kind.sign) & text.rlike(kind.pattern) if kind.sign else text.rlike(kind.pattern)


def _scanned(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    identified = F.lit(False)
    for kind in KINDS:
        identified = identified | _has(text, kind) if kind.role == IDENTIFIER else identified
    texts = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"), identified.alias("identified"))
    return texts.select("doc_id", "row", F.concat(*[_hits(F.col("text"), k) for k in range(len(KINDS))]).alias("hits"))


def _spans(scanned: DataFrame) -> DataFrame:
    """row, kind, start and end (code points, end exclusive) of every match that counts."""
    hits = scanned.select("row", F.posexplode("hits").alias("place", "hit")).select("row", "place", "hit.*")
    before = W.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    return hits.select("row", "kind", "counts", (end - F.col("n")).alias("start"), end.alias("end")).where("counts").drop("counts")


def _bins(start: Column, end: Column, reach: int) -> Column:
    """The bins that a span, widened by ``reach``, touches."""
    return F.sequence(F.floor((start - reach) / SCOPE), F.floor((end - 1 + reach) / SCOPE))


def _binned(spans: DataFrame, reach: int, name: str) -> DataFrame:
    """A row for each bin of a span; its columns under ``name``."""
    return spans.select("row", F.explode(_bins(F.col("start"), F.col("end"), reach)).alias("bin"), *[F.col(c).alias(f"{name}_{c}") for c in ("kind", "start", "end")])


def _near(a: str, b: str, reach: int) -> Column:
    """The spans ``a`` and ``b`` are at most ``reach`` characters apart; they overlap where that is below 0."""
    return (F.col(f"{a}_start") - F.col(f"{b}_end") <= reach) & (F.col(f"{b}_start") - F.col(f"{a}_end") <= reach)


def _of_role(spans: DataFrame, role: str) -> DataFrame:
    return spans.where(F.col("kind").isin([k for k, kind in enumerate(KINDS) if kind.role == role]))


@dataclass
class Credentials:
    #: row and doc_id of every document.
    documents: DataFrame
    #: row, kind (a place in ``KINDS``), start, end of every strong span and of every weak part not covered by one.
    spans: DataFrame
    #: row, identifier_kind, identifier_start, identifier_end, secret_kind, secret_start, secret_end: parts that belong together.
    links: DataFrame
    #: row, kind, start, end: endpoints in the scope of both parts of a link.
    endpoints: DataFrame

    def reported(self) -> DataFrame:
        """row, kind, start, end: strong spans, and the weak ones that are part of a link."""
        weak = F.col("kind").isin([k for k, kind in enumerate(KINDS) if kind.weak])
        parts = [self.links.select("row", *[F.col(f"{p}_{c}").alias(c) for c in ("kind", "start", "end")]).where(weak) for p in (IDENTIFIER, SECRET)]
        return self.spans.where(~weak).union(parts[0].union(parts[1]).union(self.endpoints).distinct())


def find_credentials(documents: DataFrame) -> Credentials:
    """Spans and linked credentials of ``documents`` (``doc_id``, ``text``).

    Each row is a text of its own, also where ids are null or repeat.  A null or
    empty text has no spans; an empty table gives empty results; texts of any
    length are searched whole, and other columns are ignored.  Spans of the
    same start are told apart by their kind.
    """
    stored = Stored(documents.sparkSession, "secrets")
    scanned = stored.keep(_scanned(documents))
    every = stored.keep(_spans(scanned))
    strong = every.where(F.col("kind").isin(list(BASE)))
    weak = every.where(~F.col("kind").isin(list(BASE)))
    # What a strong span covers, even in part, is not told twice.
    covered = _binned(weak, 0, "weak").join(_binned(strong, 0, "strong"), ["row", "bin"]).where(_near("weak", "strong", -1))
    same = [F.col(c) for c in ("row", "kind", "start")]
    open_weak = weak.join(covered.select("row", *[F.col(f"weak_{c}").alias(c) for c in ("kind", "start")]).distinct(), ["row", "kind", "start"], "left_anti")
    spans = stored.keep(strong.union(open_weak.select(*same, "end")))
    pairs = _binned(_of_role(spans, IDENTIFIER), SCOPE, IDENTIFIER).join(_binned(_of_role(spans, SECRET), 0, SECRET), ["row", "bin"]).where(_near(IDENTIFIER, SECRET, SCOPE))
    links = stored.keep(pairs.drop("bin").distinct())
    linked = links.select("*", F.explode(_bins(F.col("identifier_start"), F.col("identifier_end"), SCOPE)).alias("bin"))
    met = _binned(_of_role(spans, ENDPOINT), 0, ENDPOINT).join(linked, ["row", "bin"]).where(_near(ENDPOINT, IDENTIFIER, SCOPE) & _near(ENDPOINT, SECRET, SCOPE))
    endpoints = met.select("row", *[F.col(f"endpoint_{c}").alias(c) for c in ("kind", "start", "end")]).distinct()
    return Credentials(scanned.select("row", "doc_id"), spans, links, endpoints)


def digests(found: Credentials) -> DataFrame:
    """For each document n_assign, n_access, n_hex, base_sha256 of its strong spans, and spans, all that are reported."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    span = F.struct("start", "kind", "end").alias("span")
    by_row = found.reported().groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    joined = found.documents.join(by_row, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k].name}")

    base = F.filter("found", lambda s: s["kind"].isin(list(BASE)))
    return joined.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def digests_sql() -> str:
    """The same result in SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    scans = []
    for k, kind in enumerate(KINDS):
        p = quoted(kind.pattern)
        counts = " AND ".join([f"length(v) >= {kind.least}", *[f"regexp_matches(v, {quoted(h)})" for h in kind.holds]])
        scans.append(
            f"SELECT row, {k} AS kind, f, g, place, {counts} AS counts FROM (SELECT row, unnest(found) AS f, unnest(vals) AS v, unnest(gaps[:len(found)]) AS g, unnest(range(len(found))) AS place "
            f"FROM (SELECT row, regexp_extract_all(t, {p}, 0) AS found, regexp_extract_all(t, {p}, {kind.group}) AS vals, string_split_regex(t, {p}) AS gaps FROM texts))"
        )
    base = ", ".join(map(str, BASE))
    of = {role: ", ".join(str(k) for k, kind in enumerate(KINDS) if kind.role == role) for role in (IDENTIFIER, SECRET, ENDPOINT)}
    near = lambda a, b, reach: f"{a}.row = {b}.row AND {a}.s - {b}.e <= {reach} AND {b}.s - {a}.e <= {reach}"
    name = "[" + ", ".join(quoted(kind.name) for kind in KINDS) + "][kind + 1]"
    text = f"string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    counted = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k].name}" for k in BASE)
    return (
        "WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), "
        f"hits AS ({' UNION ALL '.join(scans)}), "
        "ends AS (SELECT row, kind, counts, length(f) AS n, sum(length(g) + length(f)) OVER (PARTITION BY row, kind ORDER BY place)::BIGINT AS e FROM hits), "
        "every AS (SELECT row, kind, e - n AS s, e FROM ends WHERE counts), "
        f"strong AS (SELECT * FROM every WHERE kind IN ({base})), "
        f"weak AS (SELECT * FROM every w WHERE kind NOT IN ({base}) AND NOT EXISTS (SELECT 1 FROM strong x WHERE {near('w', 'x', -1)})), "
        "spans AS (SELECT * FROM strong UNION ALL SELECT * FROM weak), "
        f"ids AS (SELECT * FROM spans WHERE kind IN ({of[IDENTIFIER]})), keys AS (SELECT * FROM spans WHERE kind IN ({of[SECRET]})), "
        f"urls AS (SELECT * FROM spans WHERE kind IN ({of[ENDPOINT]})), "
        f"links AS (SELECT i.row, i.kind AS ik, i.s AS is_, i.e AS ie, k.kind AS kk, k.s AS ks, k.e AS ke FROM ids i JOIN keys k ON {near('i', 'k', SCOPE)}), "
        f"met AS (SELECT DISTINCT u.* FROM urls u JOIN links l ON u.row = l.row AND u.s - l.ie <= {SCOPE} AND l.is_ - u.e <= {SCOPE} AND u.s - l.ke <= {SCOPE} AND l.ks - u.e <= {SCOPE}), "
        f"extra AS (SELECT row, ik AS kind, is_ AS s, ie AS e FROM links WHERE ik NOT IN ({base}) UNION SELECT row, kk, ks, ke FROM links WHERE kk NOT IN ({base}) UNION SELECT * FROM met), "
        "shown AS (SELECT * FROM strong UNION ALL SELECT * FROM extra), "
        f"listed AS (SELECT row, {counted}, {text} FILTER (kind IN ({base})) AS base, {text} AS spans FROM shown GROUP BY row) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{KINDS[k].name}, 0) AS n_{KINDS[k].name}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans "
        "FROM texts LEFT JOIN listed USING (row)"
    )
