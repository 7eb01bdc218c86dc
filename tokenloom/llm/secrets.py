"""Secret scan with corpus-wide ownership: how many repositories and owners show a candidate decides what it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.sources.workspace import stage

#: The base patterns, in the order of their kinds. A run of hexadecimal digits of 16 or more is the
#: same as any run that passes the length test; so is the access pattern, whose inner starts are shorter still.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "owned")
#: Longest runs of token characters from 20 on; those that mix letters and digits are candidates of the method.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
PATTERNS = ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (RUN, 0))
#: At most this many values can each have more than its share of all places; their counts are broadcast.
HOT = 10_000
#: A value under so many owners, or so many repositories of one owner, is widely copied.
OWNERS, REPOSITORIES = 2, 3
LIVE, EXAMPLE = "[live credential]", "[example credential]"
#: Code points of the parts in which a text is cut once before spans are replaced.
PART = 4096


def pieces(text: Column) -> Column:
    """All leftmost matches of the patterns in order, as (kind, i, before, size, value): the length of the text between the
    match before and this one, in code points, and its own. Places are their running sums. One text is cut once per
    pattern it holds; an entry without a size is what follows the last match."""
    lengths = lambda x: F.transform(x, lambda y: F.char_length(y))
    nothing = F.array().cast("array<struct<kind:int,i:int,before:int,size:int,value:string>>")

    def of_kind(kind: int, pattern: str, value: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
        zipped = F.arrays_zip(lengths(F.split(text, pattern, -1)), lengths(found), values)
        named = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["0"].alias("before"), x["1"].alias("size"), x["2"].alias("value"))
        return F.when(text.rlike(pattern), F.transform(zipped, named)).otherwise(nothing)

    return F.concat(*[of_kind(kind, pattern, value) for kind, (pattern, value) in enumerate(PATTERNS)])


def placed(rows: DataFrame) -> DataFrame:
    """Spans (row, start, end, kind, value, ...) from exploded pieces: base spans that pass their length test, and the
    runs of the method that lie outside of all of them. Texts are apart by `_row`, so all work grows with the matches."""
    so_far = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before").cast("bigint") + F.coalesce("size", F.lit(0))).over(so_far)
    spans = rows.withColumn("end", end).where("size is not null").withColumn("start", F.col("end") - F.col("size"))
    fits = F.when(F.col("kind") == 0, F.char_length("value") >= 12).when(F.col("kind") == 3, F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).otherwise(True)
    spans = spans.where(fits)
    # A run meets a base span that starts before it or with it and reaches into it, or one that starts within it.
    up = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") < 3
    marked = spans.withColumn("reach", F.max(F.when(base, F.col("end"))).over(up)).withColumn("next", F.min(F.when(base, F.col("start"))).over(down))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return marked.where(base | apart).drop("i", "before", "size", "reach", "next")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_places, n_repositories, n_owners) of every candidate value, from (digest, copy, owner, repository).

    Places of one whole text (equal `copy`) count once, where its least owner and repository has it: a copied document
    doesn't make its secrets common. Counts are exact and combined before each exchange, so a value that a third of all
    documents hold is a few rows per task.
    """
    texts = found.groupBy("digest", "copy").agg(F.min(F.struct("owner", "repository")).alias("at"), F.count("*").alias("n"))
    by_repository = texts.groupBy("digest", "at").agg(F.sum("n").alias("n"))
    by_owner = by_repository.groupBy("digest", F.col("at.owner").alias("o")).agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_places"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


SPANS = "array<struct<start:bigint,end:bigint,kind:int,example:boolean,owners:bigint,repositories:bigint,until:bigint>>"


def scan(df: DataFrame, text: str = "text", owner: Column | None = None, repository: Column | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """Add `spans` to every row, by start and kind: (start, end, kind, example, owners, repositories, until).

    `owners` and `repositories` of a span count the distinct ones of its value in the corpus; copies of one whole text
    count once. A value under as many `owners` or `repositories` as given, or more, is a widely copied example; others
    are owner-specific and so may be live. Base spans always stay, marked by `example`; token-like runs outside of them are added as
    kind 3 ("owned") where they are owner-specific, and left out where they are examples. `until` is the end of a run of
    overlapping spans at its first span, and null at the others.

    Owner and repository default to `source`, and to source and `lang`; a missing one counts as the empty name.
    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty one. A
    column `spans` is replaced. Texts are scanned once, into a stage table. Only candidates meet the counts: values
    with more than 1 / HOT of all places (fewer than HOT of them) by broadcast, so a hot value moves no row, the others by digest.
    """
    column = lambda name: F.col(name) if name in df.columns else F.lit("")
    owner = column("source") if owner is None else owner
    repository = F.concat_ws("/", column("source"), column("lang")) if repository is None else repository
    body, name = F.coalesce(F.col(text), F.lit("")), lambda c: F.coalesce(c, F.lit(""))
    staged = df.drop("spans").withColumns({"_owner": name(owner), "_repository": name(repository), "_pieces": pieces(body), "_row": F.monotonically_increasing_id()})
    staged = stage(staged, "secrets")
    some, none = staged.where("size(_pieces) > 0"), staged.where("size(_pieces) = 0")
    rows = some.select("_row", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"), F.xxhash64(text).alias("copy"), F.explode("_pieces").alias("p"))
    found = placed(rows.select("_row", "owner", "repository", "copy", "p.*")).withColumn("digest", F.xxhash64("value")).drop("value")
    found = stage(found, "secret-spans")
    counts = stage(ownership(found), "secret-counts")
    total = counts.agg(F.sum("n_places")).first()[0] or 0
    limit = max(1000, total // HOT)
    example = (F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories)
    shown = counts.select("digest", "n_places", example.alias("example"), "n_owners", "n_repositories")
    hot, rest = shown.where(F.col("n_places") > limit).drop("n_places"), shown.where(F.col("n_places") <= limit).drop("n_places")
    met = found.select("_row", "start", "end", "kind", "digest").join(F.broadcast(hot), "digest", "left")
    told = met.where("example is not null").unionByName(met.where("example is null").drop("example", "n_owners", "n_repositories").join(rest, "digest"))
    kept = told.where("kind < 3 or not example")
    # Runs of overlapping spans: one begins where no span before reaches beyond its start.
    order = Window.partitionBy("_row").orderBy("start", "kind", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = kept.withColumn("begins", F.coalesce(before <= F.col("start"), F.lit(True)))
    run = begun.withColumn("run", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ended = run.withColumn("until", F.when(F.col("begins"), F.max("end").over(Window.partitionBy("_row", "run"))))
    span = F.struct("start", "kind", "end", "example", F.col("n_owners").alias("owners"), F.col("n_repositories").alias("repositories"), "until")
    spans = ended.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    ordered = F.transform("_spans", lambda s: F.struct(*[s[x].alias(x) for x in ("start", "end", "kind", "example", "owners", "repositories", "until")]))
    empty = F.array().cast(SPANS)
    done = some.join(spans, "_row", "left").withColumn("spans", F.coalesce(ordered, empty)).drop("_spans").unionByName(none.withColumn("spans", empty))
    return done.drop("_row", "_pieces", "_owner", "_repository")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced: examples and live-looking ones by name. The text
    is cut into parts once, and each stretch between spans is taken from its own parts, so the work grows with the text."""
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    word = lambda s: F.when(s["example"], EXAMPLE).otherwise(LIVE)

    def stretch(parts: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PART).cast("int"), F.floor(end / PART).cast("int")
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        at = (start - first * PART + 1).cast("int")
        middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        apart = F.concat(F.substr(part(first), at), middle, F.substr(part(last), F.lit(1), (end - last * PART).cast("int")))
        return F.when(first == last, F.substr(part(first), at, (end - start).cast("int"))).otherwise(apart)

    def replaced(both: Column) -> Column:
        parts, runs = both["parts"], both["runs"]
        zero = F.lit(0).cast("bigint")
        ends = lambda i: F.coalesce(F.get(runs, i - 1)["until"], zero)
        said = F.transform(runs, lambda s, i: F.concat(stretch(parts, F.when(i == 0, zero).otherwise(ends(i)), s["start"]), word(s)))
        return F.concat(F.array_join(said, ""), stretch(parts, ends(F.size(runs)), F.char_length(text).cast("bigint")))

    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"), F.filter(spans, lambda s: s["until"].isNotNull()).alias("runs"))
    return F.when(F.size(spans) > 0, bound(both, replaced)).otherwise(text)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_query(documents: DataFrame) -> DataFrame:
    found = scan(documents.select("doc_id", "text", "source", "lang"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        written(F.filter("spans", lambda s: s["example"])).alias("example_spans"),
        F.array_join(F.transform("spans", lambda s: s["owners"].cast("string")), ",").alias("owners"),
        F.array_join(F.transform("spans", lambda s: s["repositories"].cast("string")), ",").alias("repositories"),
    )


def _sql() -> str:
    quote = lambda p: p.replace("'", "''")
    base = ((ASSIGN, 2, 12), (ACCESS, 0, 18), (HEX, 0, 16), (RUN, 0, 20))
    each = " UNION ALL ".join(
        f"SELECT u, {kind} AS kind, {least} AS least, string_split_regex(t, '{quote(p)}') AS b, "
        f"regexp_extract_all(t, '{quote(p)}', 0) AS m, regexp_extract_all(t, '{quote(p)}', {group}) AS v FROM d"
        for kind, (p, group, least) in enumerate(base)
    )
    names = "['" + "', '".join(KINDS) + "'][kind + 1]"
    written = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, concat_ws('/', source, lang) AS r FROM documents),
x AS ({each}),
p AS (
  SELECT u, kind, least, v[i] AS value, length(m[i]) AS n,
    list_sum(list_transform(b[:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0)::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x)),
q AS (SELECT u, kind, value, s, s + n AS e FROM p WHERE length(value) >= least),
c AS (
  SELECT * FROM q WHERE kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (FROM q o WHERE o.u = q.u AND o.kind < 3 AND o.s < q.e AND q.s < o.e))),
f AS (SELECT value, t, o, r FROM c JOIN d USING (u) QUALIFY row_number() OVER (PARTITION BY value, t ORDER BY o, r) = 1),
w AS (
  SELECT value, count(DISTINCT o) AS owners, count(DISTINCT (o, r)) AS repositories,
    count(DISTINCT o) >= {OWNERS} OR count(DISTINCT (o, r)) >= {REPOSITORIES} AS example
  FROM f GROUP BY value),
k AS (SELECT * FROM c JOIN w USING (value) WHERE kind < 3 OR NOT example),
g AS (
  SELECT u, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind = 3) AS n_owned, {written} FILTER (kind < 3) AS first, {written} AS spans, {written} FILTER (example) AS example_spans,
    string_agg(owners, ',' ORDER BY s, kind) AS owners, string_agg(repositories, ',' ORDER BY s, kind) AS repositories
  FROM k GROUP BY u)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_owned, 0) AS n_owned, sha256(coalesce(first, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(example_spans, '') AS example_spans, coalesce(owners, '') AS owners, coalesce(repositories, '') AS repositories
FROM d LEFT JOIN g USING (u)
"""


SQL = _sql()
