"""Queries on the identification catalog: search, photo features, taxon details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.functions.numeric import strip
from labspark.functions.text import NO_ESCAPE, ascii_like, ascii_lower, source_label, status_label
from labspark.session import cut_lineage

# States and scope left out of a search.
HIDDEN_STATUSES = ["deprecated", "reference_only", "critical"]
STUB_STATUS = "stub"
HIDDEN_SCOPE = "exclude_from_identification"
SEARCH_COLUMNS = ["scientific_name", "german_name", "taxon_id"]
SEARCH_LIMIT = 50
PHOTO_LIMIT = 100
# Fields looked at by the free-text filter of photo features, in order.
FEATURE_TEXT_COLUMNS = [
    "scientific_name",
    "german_name",
    "character",
    "state",
    "organ",
    "feature_group",
    "taxon_id",
    "source_note",
]
_SALTS = 64
#: Grams held by more than one in so many of all postings are spread over salts; there are fewer than that.
_HOT_GRAMS = 4096
#: Lengths of the character runs that names are indexed by; a text takes the longest that it has.
_GRAM_SIZES = (1, 2, 3, 4, 6)
#: A task tests about so many pairs of a text and a taxon at once, and takes so many postings.
_PIECE = 1 << 18
#: A taxon with more features is ranked in several pieces.
SPLIT_ROWS = 1 << 20


def visible(include_stubs: bool = False) -> Column:
    """Status and scope admit the taxon; a missing status or scope admits it."""
    hidden = HIDDEN_STATUSES if include_stubs else [*HIDDEN_STATUSES, STUB_STATUS]
    status, scope = (F.coalesce(c, F.lit("")) for c in ("status", "app_scope"))
    return ~status.isin(hidden) & (scope != HIDDEN_SCOPE)


def name_matches(query: str) -> Column:
    pattern = f"%{query.strip()}%"
    found = [F.coalesce(ascii_like(F.col(c), pattern), F.lit(False)) for c in SEARCH_COLUMNS]
    return found[0] | found[1] | found[2]


def matching_taxa(taxa: DataFrame, query: str = "", include_stubs: bool = False) -> DataFrame:
    """All hits of a search; an empty query has no name condition."""
    hits = taxa.filter(visible(include_stubs))
    return hits.filter(name_matches(query)) if query.strip() else hits


def search_taxa(
    taxa: DataFrame, query: str = "", include_stubs: bool = False, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """The first hits by ``taxon_id`` (a top-k, so no full sort)."""
    return matching_taxa(taxa, query, include_stubs).orderBy("taxon_id").limit(limit)


def search_envelope(
    taxa: DataFrame, query: str = "", include_stubs: bool = False, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """Number of rows returned, the truncation flag (also set on exactly ``limit`` hits) and all hits."""
    total = F.count(F.lit(1))
    shown = F.least(total, F.lit(limit))
    return matching_taxa(taxa, query, include_stubs).agg(
        shown.alias("count"),
        F.lit(limit).alias("limit"),
        (shown == limit).alias("maybe_truncated"),
        F.lit(include_stubs).alias("include_stubs"),
        total.alias("total_hits"),
    )


def batch_search(
    taxa: DataFrame,
    queries: Sequence[str],
    include_stubs: bool = False,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """Many searches in one scan: ``query, position`` and the taxon columns of the first hits of each.

    The search texts are a list in the caller's hands; each becomes a constant pattern evaluated on the row,
    so there is no join and only real hits leave the one scan.  The hits of a query are cut to ``limit`` in
    parts first, so a query that matches everything never has all its hits in one task, at any limit.
    """
    base = taxa.filter(visible(include_stubs))
    texts = list(dict.fromkeys(q.strip() for q in queries))
    if not texts:
        return base.select(F.lit("").alias("query"), F.lit(0).alias("position"), *base.columns).limit(0)
    found = F.array_compact(
        F.array(*[F.when(name_matches(q) if q else F.lit(True), F.lit(q)) for q in texts])
    )
    hits = base.select(F.explode(found).alias("query"), *base.columns)
    part = Window.partitionBy("query", F.pmod(F.xxhash64("taxon_id"), F.lit(_SALTS))).orderBy("taxon_id")
    order = Window.partitionBy("query").orderBy("taxon_id")
    return (
        hits.withColumn("position", F.row_number().over(part))
        .filter(F.col("position") <= limit)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("query", "position", *base.columns)
    )


def _grams(text: Column, n: Column | int) -> Column:
    """All runs of ``n`` characters of a text; none if it is shorter."""
    size = F.lit(n) if isinstance(n, int) else n
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substr(text, i, size))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def search_table(
    taxa: DataFrame, queries: DataFrame, include_stubs: bool = False, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """As :func:`batch_search` for a table ``queries(query)`` of any size; null texts search for nothing.

    The names of visible taxa are indexed by their runs of up to six characters (``_GRAM_SIZES``).  A text is looked up by
    its rarest run between wildcards, and the pattern is tested on the taxa found, so no pattern meets the whole
    catalog.  The pairs of texts and taxa of a run are counted before they are made: runs of many are cut into
    pieces by taxon, so that a task has about as many in a catalog of any size.  A text of wildcards alone asks for names of some length only; such texts share one scan.  Rows that repeat are one hit each.
    """
    base = taxa.filter(visible(include_stubs))
    row = F.struct(*base.columns)
    texts = queries.select(strip(F.col("query")).alias("query")).filter("query is not null").distinct()
    folded = ascii_lower(F.col("query"))
    runs = F.split(folded, "[%_]+")
    longest = F.array_max(F.transform(runs, F.length))
    size = F.array_max(F.filter(F.array(*map(F.lit, _GRAM_SIZES)), lambda n: n <= longest))
    grams = F.when(longest > 0, F.array_distinct(F.flatten(F.transform(runs, lambda r: _grams(r, size)))))
    texts = cut_lineage(texts.select("query", grams.alias("grams")))

    lowered = [ascii_lower(F.col(c)) for c in SEARCH_COLUMNS]
    held = [F.coalesce(_grams(name, n), F.expr("cast(array() as array<string>)")) for name in lowered for n in _GRAM_SIZES]
    postings = base.select(row.alias("taxon"), F.explode(F.array_distinct(F.concat(*held))).alias("gram"))
    least_parts = int(taxa.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_texts = max(least_parts, -(-texts.count() // _PIECE))
    asked = texts.repartition(n_texts, "query").select("query", F.posexplode("grams").alias("at", "gram"))
    asking = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    sizes = cut_lineage(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(asking, "gram"))
    held_by_all, asked_by_all = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "texts"))).first()
    # Grams that many texts share, fewer than _HOT_GRAMS, meet the texts by broadcast.
    shared = F.broadcast(sizes.filter(F.col("texts") * _HOT_GRAMS > asked_by_all).select("gram", "n"))
    counted = asked.join(shared, "gram").unionByName(asked.join(shared, "gram", "left_anti").join(sizes.select("gram", "n"), "gram", "left"))
    # A gram that no taxon holds leaves no hit, so it is the rarest.
    rarest = counted.groupBy("query").agg(F.min(F.shiftleft(F.coalesce("n", F.lit(0)).cast("long"), 24) + F.col("at")).alias("key"))
    n, at = F.shiftright("key", 24), F.col("key").bitwiseAND((1 << 24) - 1).cast("int")
    wanted = cut_lineage(rarest.select("query", folded.alias("folded"), F.get(grams, at).alias("gram"), n.alias("n")).filter("n > 0"))
    pairs = F.col("n") * F.count(F.lit(1))
    load = cut_lineage(wanted.groupBy("gram", "n").agg(pairs.alias("pairs")))
    # Fewer than _HOT_GRAMS rows, and one more for each _PIECE pairs at most.
    hot = (F.col("n") * _HOT_GRAMS > held_by_all) | (F.col("pairs") > _PIECE)
    cut = F.broadcast(load.filter(hot).select("gram", F.ceil(F.col("pairs") / _PIECE).cast("int").alias("pieces")))
    n_cold = max(least_parts, -(-held_by_all // _PIECE))
    n_hot = max(least_parts, -(-load.filter(hot).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] // _PIECE))
    alone = F.lit(0).alias("salt")
    cold = postings.join(cut, "gram", "left_anti").select("gram", alone, "taxon").repartition(n_cold, "gram")
    cold = cold.join(wanted.join(cut, "gram", "left_anti").select("gram", "query", "folded").repartition(n_cold, "gram"), "gram")
    by_taxon = F.pmod(F.xxhash64("taxon.taxon_id"), F.col("pieces")).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("salt")
    spread = postings.join(cut, "gram").select("gram", by_taxon, "taxon").repartition(n_hot, "gram", "salt")
    spread = spread.join(wanted.join(cut, "gram").select("gram", every, "query", "folded").repartition(n_hot, "gram", "salt"), ["gram", "salt"])
    met = cold.unionByName(spread)
    pattern = F.concat(F.lit("%"), F.col("folded"), F.lit("%"))

    def matches(column: str) -> Column:
        name = ascii_lower(F.col(f"taxon.{column}"))
        like = F.when(F.col("folded").rlike("[%_]"), F.like(name, pattern, F.lit(NO_ESCAPE))).otherwise(name.contains(F.col("folded")))
        return F.coalesce(like, F.lit(False))

    found = [matches(c) for c in SEARCH_COLUMNS]
    hits = met.filter(found[0] | found[1] | found[2]).select("query", "taxon", "salt")
    first = _first(hits, ["query"], limit, F.col("salt"))

    # Without a fixed character only the least length counts; an empty text has no condition at all.
    least = F.when(F.col("query") == "", -1).otherwise(F.length(F.regexp_replace("query", "[^_]", "")))
    open_texts = texts.filter("grams is null").select("query", least.alias("least"))
    reach = F.greatest(*(F.coalesce(F.length(c), F.lit(-1)) for c in SEARCH_COLUMNS))
    widest = base.agg(F.coalesce(F.max(reach), F.lit(-1))).first()[0]
    # At most one number for each length that a name has.
    steps = sorted(r.least for r in open_texts.filter(F.col("least") <= widest).select("least").distinct().collect())
    if steps:
        # A taxon counts for the greatest of the numbers that it reaches; only the first of each go on to the smaller ones.
        numbers = F.array(*map(F.lit, steps))
        most = F.array_max(F.filter(numbers, lambda n: n <= reach))
        parts = max(least_parts, -(-base.count() // _PIECE))
        dealt = base.select(most.alias("most"), row.alias("taxon")).filter("most is not null")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("taxon"), F.lit(parts))).repartition(parts, "part")
        few = _first(dealt, ["most"], limit, F.col("part")).select(F.explode(F.filter(numbers, lambda n: n <= F.col("most"))).alias("least"), "taxon")
        shared = _first(few, ["least"], limit, F.lit(0))
        first = first.unionByName(open_texts.join(F.broadcast(shared), "least").select("query", "position", "taxon"))
    return first.select("query", "position", "taxon.*")


def _first(hits: DataFrame, keys: list[str], limit: int, part: Column) -> DataFrame:
    """The first ``limit`` taxa of each key by ``taxon_id``, cut in the parts that ``part`` tells before they meet."""
    order = [F.col("taxon.taxon_id"), F.col("taxon")]
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    few = hits.withColumn("position", F.row_number().over(inside)).filter(F.col("position") <= limit).select(*keys, "taxon")
    return few.withColumn("position", F.row_number().over(whole)).filter(F.col("position") <= limit)


def with_labels(taxa: DataFrame) -> DataFrame:
    return taxa.withColumns(
        {"status_label": status_label(F.col("status")), "source_label": source_label(F.col("source_pdf"))}
    )


def find_taxon(taxa: DataFrame, taxon_id: str | int) -> DataFrame:
    """The taxon with this id, or no row; the predicate reaches the scan."""
    wanted = taxon_id.strip() if isinstance(taxon_id, str) else taxon_id
    return taxa.filter(F.col("taxon_id") == F.lit(wanted))


def photo_features(
    features: DataFrame, taxa: DataFrame, visibility: str | None = None, weight: str | None = None
) -> DataFrame:
    """Features of one visibility and weight with their taxon's names; features without taxon stay."""
    wanted = (F.col("visibility_in_photo") == (visibility or "high").strip()) & (
        F.col("diagnostic_weight") == (weight or "high").strip()
    )
    names = taxa.select("taxon_id", "scientific_name", "german_name", "rank")
    return features.filter(wanted).join(names, "taxon_id", "left")


def first_photo_features(photo: DataFrame, limit: int = PHOTO_LIMIT) -> DataFrame:
    """The first features by name, organ, character and, to make the order total, feature id."""
    return photo.orderBy("scientific_name", "organ", "character", "feature_id").limit(limit)


def feature_text_filter(photo: DataFrame, term: str) -> DataFrame:
    """Features whose joined text fields contain the term, ignoring case; apply before or after the top-k."""
    wanted = term.strip().lower()
    if not wanted:
        return photo
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FEATURE_TEXT_COLUMNS]
    return photo.filter(F.lower(F.concat_ws(" ", *fields)).contains(wanted))


def taxon_details(taxa: DataFrame, features: DataFrame) -> DataFrame:
    """Every taxon with its number of features and, flat, one row per feature.

    A taxon may own any share of all features, so they are rows and never one nested list.  Counts are
    combined before their shuffle.  Features of taxa beyond ``SPLIT_ROWS`` features meet them by broadcast, as there
    is less than one such taxon for each ``SPLIT_ROWS`` rows; only the others are shuffled by their taxon.  Taxa
    without features are added from the counts.
    """
    counts = features.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("features_count"))
    counted = taxa.join(counts, "taxon_id", "left").withColumn(
        "features_count", F.coalesce("features_count", F.lit(0))
    )
    shared = [c for c in features.columns if c in taxa.columns and c != "taxon_id"]
    own = features.withColumnsRenamed({c: f"feature_{c}" for c in shared})
    large = F.broadcast(counts.filter(F.col("features_count") > SPLIT_ROWS).select("taxon_id"))
    few = own.join(large, "taxon_id", "left_anti").join(counted.filter(F.col("features_count").between(1, SPLIT_ROWS)), "taxon_id")
    many = own.join(F.broadcast(counted.filter(F.col("features_count") > SPLIT_ROWS)), "taxon_id")
    bare = counted.filter("features_count = 0")
    return few.unionByName(many).unionByName(bare, allowMissingColumns=True).select(
        *counted.columns, *[c for c in own.columns if c != "taxon_id"]
    )


_FEATURE_ORDER = ["organ", "feature_group", "character", "feature_id"]


def ranked_details(details: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``details`` with ``position``: the place of a feature in its taxon, by organ, group, character and id.

    Taxa of up to ``split_rows`` features are numbered by a window.  The features of larger ones, and only they,
    are dealt out by ranges of their order, so many that a piece has about ``SPLIT_ROWS`` rows at most; a piece
    numbers its rows and adds the rows of the pieces before it.  So no taxon is in one task, and the rest is never sorted as a whole.  A taxon without features has no
    position; features that agree in all of the order are numbered in any order.
    """
    small = Window.partitionBy("taxon_id").orderBy(*_FEATURE_ORDER)
    bare = details.filter("features_count = 0").withColumn("position", F.lit(None).cast("long"))
    cold = details.filter(F.col("features_count").between(1, split_rows)).withColumn("position", F.row_number().over(small).cast("long"))
    large = details.filter(F.col("features_count") > split_rows)
    ranges = max(int(details.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-large.count() // SPLIT_ROWS))
    # Ranges come from a sample, so the rows are written with their piece before pieces are counted.  Equal
    # features are told apart by a number, as equal keys would all go to one range.
    pieces = cut_lineage(
        large.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(ranges, "taxon_id", *_FEATURE_ORDER, "_tie")
        .withColumn("_piece", F.spark_partition_id())
    )
    before = Window.partitionBy("taxon_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("taxon_id", "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("taxon_id", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("taxon_id", "_piece").orderBy(*_FEATURE_ORDER, "_tie")
    hot = pieces.join(offsets, ["taxon_id", "_piece"]).withColumn("position", F.row_number().over(inside) + F.col("_offset"))
    return cold.unionByName(hot.select(*cold.columns)).unionByName(bare)


def ordered_details(details: DataFrame) -> DataFrame:
    """Global order by taxon, then organ, group, character and id: a range sort, split inside a taxon too."""
    return details.orderBy("taxon_id", "organ", "feature_group", "character", "feature_id")
