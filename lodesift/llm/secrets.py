"""Secret scanning with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found in each text by pattern; only their positions and the SHA-256 of their values leave the
row. Over the corpus, a value's hash is aggregated by distinct owners and distinct repositories: a
value that many owners or many repositories carry is a copied example; one that fewer have, of both, and that
looks generated is a live-looking credential, leaked in one place or spread to a few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import free_names, materialize, maybe_in

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
#: Kinds in the order in which spans at one start are listed; the last two are added by the method.
KINDS = ("assign", "access", "hex", "example", "live")
#: A value that so many owners have, at least, is an example.
EXAMPLE_OWNERS = 3
#: A value that so many repositories have, at least, is an example, whoever owns them.
EXAMPLE_REPOSITORIES = 10
LIVE_CHARS = 16
#: Lower-cased values with one of these in them are placeholders.
PLACEHOLDERS = ("example", "changeme", "placeholder", "password", "dummy", "sample", "xxxx", "your_", "your-", "redacted", "todo")
MASK = "[secret]"
#: Matches that are numbered at once, so that many matches in a text cost in proportion.
BLOCK = 128

_FOUND = "array<struct<kind:int,start:int,end:int,from:int,hash:string,live:boolean>>"


def looks_live(value: Column) -> Column:
    """Long enough, with letters and digits, many different characters, and no placeholder."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 8) & ~F.lower(value).rlike("|".join(PLACEHOLDERS))


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that don't overlap, with positions in code points: what stands between them is what a
    split leaves, so positions are sums of lengths."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), (end - F.length(x["value"])).alias("from"), F.sha2(x["value"], 256).alias("hash"), looks_live(x["value"]).alias("live"))
        return F.struct(end.alias("at"), F.when(F.coalesce(F.length(x["value"]) >= least, F.lit(False)), F.concat(state["found"], F.array(one).cast(_FOUND))).otherwise(state["found"]).alias("found"))

    def block(p: Column, b: Column) -> Column:
        return F.aggregate(F.slice(p, b * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found")), step)

    def shifted(x: Column, by: Column) -> Column:
        return F.transform(x["found"], lambda m: F.struct(m["kind"].alias("kind"), (m["start"] + by).alias("start"), (m["end"] + by).alias("end"), (m["from"] + by).alias("from"), m["hash"].alias("hash"), m["live"].alias("live")))

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        return F.flatten(F.zip_with(blocks, starts, shifted))

    each = _with(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: block(p, b)))
    return _with(each, placed)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kinds(text: Column) -> list[tuple[Column, str, int, int]]:
    """For each base kind: what a text must hold for it to be tried, the pattern, the group, its least length."""
    low = F.lower(text)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    return [(named, ASSIGN, 2, 8), (text.contains("AKIA"), ACCESS, 1, 16), (text.rlike(HEX), HEX, 1, 32)]


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, from, hash, live>> of the base kinds in a text; empty for null. The value
    is what stands between from and end."""
    none = F.array().cast(_FOUND)
    return F.concat(*[F.when(F.coalesce(may, F.lit(False)), _matches(text, k, pattern, group, least)).otherwise(none) for k, (may, pattern, group, least) in enumerate(_kinds(text))])


def values(text: Column) -> Column:
    """The values of the candidates in a text, longest first."""
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(F.coalesce(may, F.lit(False)), F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v, least=least: F.length(v) >= least)).otherwise(none) for may, pattern, group, least in _kinds(text)])
    longest = F.array_sort(F.transform(F.array_distinct(found), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.transform(longest, lambda x: x["v"])


def ownership(found: DataFrame) -> DataFrame:
    """found: (hash, owner, repository). (hash, owners, repositories): distinct ones of each; a repository
    belongs to its owner, and null counts as one owner or repository. Each of the aggregations is combined
    before its exchange, so that a value of which there are very many copies costs no more than others."""
    pairs = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("one").alias("n"))
    return owners.groupBy("hash").agg(F.count("n").alias("owners"), F.sum("n").alias("repositories"))


def _scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, mark, found) for each row of docs, and (row, hash, kind, start, end) for each of its values that is an
    example or a live-looking one."""
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repository"), F.xxhash64(text_col).alias("mark"), candidates(F.col(text_col)).alias("found"))
    scanned = materialize(scanned, "scanned")
    each = scanned.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("c"))
    each = each.select("row", "owner", "repository", "c.hash", "c.live", F.col("c.from").alias("start"), "c.end")
    counts = ownership(each)
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    judged = each.join(counts, "hash").withColumn("kind", F.when(copied, KINDS.index("example")).when(F.col("live"), KINDS.index("live")))
    return scanned, judged.where("kind is not null").select("row", "hash", "kind", "start", "end")


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live), a row for each row of docs.

    Base spans are whole matches. The method adds a span `example` or `live` over each value that the corpus
    shows to be one. Where no repository column is named, each document is its own repository. Null
    and empty texts have no spans; repeated rows stay repeated and count once in the corpus; an empty table
    gives no rows; other columns aren't read."""
    scanned, judged = _scanned(docs, id_col, text_col, owner_col, repo_col or id_col)
    added = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    joined = scanned.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    joined = joined.withColumn("added", _with(F.col("added"), lambda s: F.filter(s, lambda x, i: F.coalesce(x != F.get(s, i - 1), F.lit(True)))))
    base = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    of = lambda spans, k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return joined.select(
        "doc_id",
        *[of("found", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_text_of(base), 256).alias("base_sha256"),
        _text_of(F.concat(base, F.col("added"))).alias("spans"),
        *[of("added", k).alias(f"n_{KINDS[k]}") for k in (3, 4)],
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, chars_col: str = "n_chars") -> DataFrame:
    """docs with every live-looking value that isn't a copied example masked in its text, and the number of characters set
    anew in those; columns, whatever their names, and all other rows as they were. Values don't leave their row.
    Null and empty texts stay; repeated rows stay repeated; an empty table gives no rows.

    Of the rows themselves, only those that a filter of bounded size can't rule out to hold such a value meet the
    decision in an exchange."""
    scanned, judged = _scanned(docs, id_col, text_col, owner_col, repo_col or id_col)
    key, live_id, mark, live = free_names(docs, "key", "live_id", "mark", "live")
    hashes = judged.where(F.col("kind") == KINDS.index("live")).groupBy("row").agg(F.collect_set("hash").alias(live))
    told = scanned.join(hashes, "row").select(F.xxhash64("doc_id", "mark").alias(f"{key}_"), F.col("doc_id").alias(live_id), F.col("mark").alias(mark), live)
    told = materialize(told.dropDuplicates([live_id, mark]), "live")
    perhaps = maybe_in(told, f"{key}_")
    own = docs.withColumn(key, F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    exact = (F.col(key) == F.col(f"{key}_")) & F.col(id_col).eqNullSafe(F.col(live_id)) & (F.xxhash64(text_col) == F.col(mark))
    met = own.where(perhaps(F.col(key))).join(told, exact, "left")
    masked = F.aggregate(F.filter(values(F.col(text_col)), lambda v: F.array_contains(live, F.sha2(v, 256))), F.col(text_col), lambda text, v: F.replace(text, v, F.lit(MASK)))
    met = met.withColumn(text_col, F.when(F.col(live).isNotNull(), masked).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        met = met.withColumn(chars_col, F.when(F.col(live).isNotNull(), F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return own.where(~perhaps(F.col(key))).select(*columns).unionByName(met.select(*columns))


_SQL_KINDS = ((ASSIGN, 2, 8, "regexp_matches(lower(t), 'password|passwd|secret|token|api_?key')"), (ACCESS, 1, 16, "contains(t, 'AKIA')"), (HEX, 1, 32, "true"))


def _sql_matches(kind: int) -> str:
    pattern, group, least, may = _SQL_KINDS[kind]
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, source, doc_id, {kind} AS kind, s AS start, s + length(w[k]) AS stop, v[k] AS value FROM (
  SELECT *, coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM (SELECT *, regexp_extract_all(t, '{quoted}') AS w, regexp_extract_all(t, '{quoted}', {group}) AS v, string_split_regex(t, '{quoted}') AS g FROM rows WHERE {may})))
  WHERE length(v[k]) >= {least}"""


_SQL_NAMED = "CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END || ':' || start || ':' || stop"
_SQL_LIVE = f"length(value) >= {LIVE_CHARS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(lower(value), '{'|'.join(PLACEHOLDERS)}')"
#: What scan() returns for documents, each of which is its own repository and whose source owns it.
ORACLE = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(map(_sql_matches, range(3)))}),
counts AS (SELECT value, count(*) AS owners, sum(n) AS repositories FROM (SELECT value, source, count(*) AS n FROM (SELECT DISTINCT value, source, doc_id FROM found) GROUP BY value, source) GROUP BY value),
added AS (SELECT DISTINCT r, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} THEN 3 WHEN {_SQL_LIVE} THEN 4 END AS kind, stop - length(value) AS start, stop FROM found JOIN counts USING (value)),
every AS (SELECT r, kind, start, stop FROM found UNION ALL SELECT r, kind, start, stop FROM added WHERE kind IS NOT NULL),
told AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS))},
  coalesce(string_agg({_SQL_NAMED}, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '') AS base, coalesce(string_agg({_SQL_NAMED}, ',' ORDER BY start, kind, stop), '') AS spans FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM rows LEFT JOIN told USING (r)
"""
