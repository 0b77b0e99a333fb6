"""Queries over the driver's tables, one or more per operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrove import schema as S
from lexigrove.config import IndexConfig, TypoTolerance
from lexigrove.engine import SearchIndex
from lexigrove.functions import geo
from lexigrove.functions.language import detect_column
from lexigrove.functions.stem import compounds, stem_column
from lexigrove.functions.text import WORD, fold_sql
from lexigrove.operators import facets, matching, paging, postings, ranking
from lexigrove.params import BrowseParams, SearchParams
from lexigrove.plans.filters import compile_filter, parse
from lexigrove.plans.query import Query, parse_query
from lexigrove.plans.sorting import order_columns, parse_sort

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# text analysis

CONFIG = IndexConfig(primary_key="doc_id", searchable=("text",), filterable=("lang", "source", "n_chars"), sortable=("n_chars", "source"))
POSTINGS_SQL = f"""w AS (
  SELECT doc_id, regexp_extract_all(text, '{WORD.replace("'", "''")}') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS position FROM w
), post AS (
  SELECT {fold_sql("word")} AS term, doc_id, CAST(position AS INTEGER) AS position, {fold_sql("word")} <> lower(word) AS folded FROM p
), vocab AS (
  SELECT term, CAST(length(term) AS INTEGER) AS length FROM post GROUP BY term
)"""


def documents_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.postings(table(spark, sf_dir, "documents"), [("text", S.STRING)])


@register("tokenize_postings", f"WITH {POSTINGS_SQL} SELECT term, doc_id, position, folded FROM post")
def tokenize_postings(spark, sf_dir):
    return documents_postings(spark, sf_dir).drop("attribute")


@register("postings_two_attributes", f"""WITH x AS (
  SELECT p_partkey AS doc_id, regexp_extract_all(p_name, '{WORD.replace("'", "''")}') AS a, regexp_extract_all(p_type, '{WORD.replace("'", "''")}') AS b FROM part
), y AS (
  SELECT doc_id, unnest(a) AS word, 0 AS attribute, unnest(range(1, len(a) + 1)) AS position FROM x
  UNION ALL SELECT doc_id, unnest(b), 1, unnest(range(len(a) + 1, len(a) + len(b) + 1)) FROM x
) SELECT {fold_sql("word")} AS term, doc_id, attribute, CAST(position AS INTEGER) AS position, {fold_sql("word")} <> lower(word) AS folded FROM y""")
def postings_two_attributes(spark, sf_dir):
    return postings.postings(table(spark, sf_dir, "part"), [("p_name", S.STRING), ("p_type", S.STRING)], "p_partkey")


@register("vocabulary", f"WITH {POSTINGS_SQL} SELECT term, length FROM vocab")
def vocabulary(spark, sf_dir):
    return postings.vocabulary(documents_postings(spark, sf_dir))


@register("prefix_table", f"WITH {POSTINGS_SQL}, e AS (SELECT term, unnest(range(3, least(14, length - 1) + 1)) AS i FROM vocab WHERE length > 3) SELECT substr(term, 1, i) AS prefix, term FROM e")
def prefix_table(spark, sf_dir):
    return postings.prefixes(postings.vocabulary(documents_postings(spark, sf_dir)), 3, 14)


@register("compound_parts", f"""WITH {POSTINGS_SQL}, c AS (SELECT term, unnest(range(4, length - 3)) AS i FROM vocab WHERE length >= 8),
h AS (SELECT c.term, substr(c.term, 1, i) AS head, substr(c.term, i + 1) AS rest FROM c JOIN vocab v ON v.term = substr(c.term, 1, i)),
f AS (SELECT h.term, head, substr(rest, length(filler) + 1) AS tail FROM h, (SELECT unnest(['', 's', 'es', 'n', 'en', 'er']) AS filler) x WHERE starts_with(rest, filler)),
b AS (SELECT f.term, head, tail FROM f JOIN vocab v ON v.term = f.tail WHERE length(tail) >= 4)
SELECT DISTINCT term, unnest([head, tail]) AS part FROM b""")
def compound_parts(spark, sf_dir):
    return compounds(postings.vocabulary(documents_postings(spark, sf_dir)))


@register("stems")
def stems(spark, sf_dir):
    """No SQL: the stemmers are Python."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    pairs = postings.postings(docs, [("text", S.STRING)], "lang").select("term", F.col("doc_id").alias("lang")).distinct()
    return pairs.withColumn("stem", stem_column(F.col("term"), F.col("lang")))


@register("language_detection")
def language_detection(spark, sf_dir):
    """No SQL: the profiles are Python."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", detect_column(F.col("text")).alias("detected"))


@register("posting_variants_first", f"""WITH {POSTINGS_SQL}, v AS (
  SELECT term, doc_id, position, folded, FALSE AS variant FROM post UNION ALL SELECT substr(term, 1, 4), doc_id, position, TRUE, TRUE FROM post
) SELECT term, doc_id, position, folded, variant FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, position, term ORDER BY variant) = 1""")
def posting_variants_first(spark, sf_dir):
    repeated = table(spark, sf_dir, "documents").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return postings.with_form(documents_postings(spark, sf_dir), F.substring("term", 1, 4), repeated).drop("attribute")


@register("automaton_states")
def automaton_states(spark, sf_dir):
    """No SQL: a fold with a growing list."""
    return postings.vocabulary(documents_postings(spark, sf_dir)).select("term", postings.states(F.col("term"), 4, 14).alias("states"))


# matching terms


def _term_condition(t, config: IndexConfig) -> str:
    literal, n, k = t.term.replace("'", "''"), len(t.term), config.typo.allowed(t.term)
    out = [f"term = '{literal}'"]
    if t.phrase is None:
        if k:
            out.append(f"(length BETWEEN {n - 1} AND {n + 1} AND damerau_levenshtein(term, '{literal}') + CASE WHEN left(term, 1) <> left('{literal}', 1) THEN 1 ELSE 0 END <= {k})")
        if t.last and n >= config.min_prefix_length:
            out.append(f"starts_with(term, '{literal}')")
    return " OR ".join(out)


def _typos(t, config: IndexConfig) -> str:
    if t.phrase is not None or not config.typo.enabled:
        return "0"
    literal = t.term.replace("'", "''")
    return f"CASE WHEN term = '{literal}' THEN 0 ELSE damerau_levenshtein(term, '{literal}') + CASE WHEN left(term, 1) <> left('{literal}', 1) THEN 1 ELSE 0 END END"


def _terms_sql(text: str, config: IndexConfig = CONFIG) -> str:
    parts = [f"SELECT {t.index} AS token, term, CAST({_typos(t, config)} AS INTEGER) AS typos, term = '{t.term}' AS same FROM vocab WHERE {_term_condition(t, config)}" for t in parse_query(text, config).tokens]
    return f"WITH {POSTINGS_SQL} " + " UNION ALL ".join(parts)


def _terms(text: str) -> Build:
    def build(spark, sf_dir):
        return matching.term_matches(postings.vocabulary(documents_postings(spark, sf_dir)), parse_query(text, CONFIG).tokens, CONFIG)

    return build


for _name, _text in (("term_exact", "the was"), ("term_prefix", "and thou"), ("term_typo_one", "onend to"), ("term_typo_two", "thernding to"), ("term_swap", "oneden to"), ("term_first_letter", "xnonti to"), ("term_phrase_is_exact", '"onthe and"')):
    register(_name, _terms_sql(_text))(_terms(_text))


# documents that match, and their rank


def _match_sql(query: Query, matching_strategy: str, config: IndexConfig = CONFIG) -> str:
    """CTEs up to ``found``: per matching document the tokens' positions, typos and exactness."""
    out = [POSTINGS_SQL]
    for t in query.tokens:
        out.append(f"m{t.index} AS (SELECT term, {_typos(t, config)} AS typos, term = '{t.term}' AS same FROM vocab WHERE {_term_condition(t, config)})")
        out.append(f"h{t.index} AS (SELECT post.doc_id, position, typos, same AND folded = {str(t.folded).upper()} AS exact FROM post JOIN m{t.index} ON post.term = m{t.index}.term)")
    for g in query.groups():
        out.append(f"c{g[0].index} AS (SELECT * FROM h{g[0].index})")
        for before, t in zip(g, g[1:]):
            out.append(f"c{t.index} AS (SELECT h.* FROM h{t.index} h SEMI JOIN c{before.index} b ON h.doc_id = b.doc_id AND h.position = b.position + 1)")
    for t in query.tokens:
        out.append(f"d{t.index} AS (SELECT doc_id, list(DISTINCT position) AS k{t.index}, min(typos) AS t{t.index}, bool_or(exact) AS e{t.index} FROM c{t.index} GROUP BY doc_id)")
    flags = [(g[0].negated, f"k{g[-1].index} IS NOT NULL") for g in query.groups()]
    positive = [f for n, f in flags if not n]
    where = " AND ".join([f"({(' AND ' if matching_strategy == 'all' else ' OR ').join(positive)})"] * bool(positive) + [f"NOT ({f})" for n, f in flags if n]) or "TRUE"
    joins = " ".join(f"LEFT JOIN d{t.index} ON documents.doc_id = d{t.index}.doc_id" for t in query.tokens)
    out.append(f"found AS (SELECT documents.*, {', '.join(f'k{t.index}, t{t.index}, e{t.index}' for t in query.tokens)} FROM documents {joins} WHERE {where})")
    return "WITH " + ", ".join(out)


def matched(spark: SparkSession, sf_dir: str, query: Query, strategy: str = "any", config: IndexConfig = CONFIG) -> DataFrame:
    rows = documents_postings(spark, sf_dir)
    return matching.matching_documents(table(spark, sf_dir, "documents"), rows, postings.vocabulary(rows), query, config, strategy)


def _search(text: str, strategy: str) -> Build:
    def build(spark, sf_dir):
        return matched(spark, sf_dir, parse_query(text, CONFIG), strategy).select("doc_id")

    return build


SEARCHES = {
    "search_one_term": ("thou", "any"),
    "strategy_any": ("onend thernding of", "any"),
    "strategy_all": ("onthe reon the", "all"),
    "phrase_two": ('"of the"', "any"),
    "phrase_three": ('"the and of"', "any"),
    "phrases_all": ('"of the" "in the"', "all"),
    "phrase_and_term": ('"to the" and', "all"),
    "negated_term": ("the -queque", "any"),
    "negated_phrase": ('the -"of the"', "any"),
    "only_negated": ("-the", "any"),
    "query_with_fold": ("ciónes über", "any"),
}
for _name, (_text, _how) in SEARCHES.items():
    register(_name, f"{_match_sql(parse_query(_text, CONFIG), _how)} SELECT doc_id FROM found")(_search(_text, _how))


def _rule_sql(query: Query, name: str) -> str:
    """A ranking rule for one or two tokens and one attribute."""
    has = [f"CASE WHEN k{t.index} IS NOT NULL THEN 1 ELSE 0 END" for t in query.tokens]
    n = f"CAST({len(query.tokens)} AS DOUBLE)"
    if name == "words":
        return f"({' + '.join(has)}) / {n}"
    if name == "exactness":
        return f"({' + '.join(f'CASE WHEN k{t.index} IS NOT NULL AND e{t.index} THEN 1 ELSE 0 END' for t in query.tokens)}) / {n}"
    if name == "typo":
        return f"exp(-0.1 * ({' + '.join(f'coalesce(t{t.index}, 0)' for t in query.tokens)}))"
    if name == "proximity" and len(query.tokens) == 2:
        ahead = "list_min(list_filter(k1, lambda x: x > list_min(k0)))"
        return f"CASE WHEN k0 IS NULL OR k1 IS NULL THEN 1.0 WHEN {ahead} IS NULL THEN 0.5 ELSE CASE WHEN {ahead} = list_min(k0) + 1 THEN 1.0 ELSE exp(-0.1 * ({ahead} - list_min(k0))) END END"
    return "1.0"


_RANKED = "there onthe"


def _ranked(rule: str) -> Build:
    def build(spark, sf_dir):
        query = parse_query(_RANKED, CONFIG)
        value = ranking.score(query, CONFIG) if rule == "score" else ranking.rule(rule, query, CONFIG)
        return matched(spark, sf_dir, query).select("doc_id", F.round(value, 5).alias("score"))

    return build


def _score_sql(query: Query) -> str:
    total = " + ".join(f"{0.7**i!r} * ({_rule_sql(query, r)})" for i, r in enumerate(CONFIG.ranking_rules))
    return f"({total}) / {sum(0.7**i for i in range(5))!r}"


for _rule in ("words", "typo", "proximity", "exactness", "score"):
    _q = parse_query(_RANKED, CONFIG)
    register(f"rank_{_rule}", f"{_match_sql(_q, 'any')} SELECT doc_id, round({_score_sql(_q) if _rule == 'score' else _rule_sql(_q, _rule)}, 5) AS score FROM found")(_ranked(_rule))


TWO = IndexConfig(primary_key="p_partkey", searchable=("p_name", "p_type"), typo=TypoTolerance(enabled=False))


def _has(column: str, word: str) -> str:
    return f"list_contains(list_transform(regexp_extract_all({column}, '[A-Za-z0-9]+'), lambda w: lower(w)), '{word}')"


@register("rank_attribute", f"""SELECT p_partkey, CAST(CASE WHEN {_has("p_name", "small")} THEN 1.0 WHEN {_has("p_type", "small")} THEN 0.8 ELSE 1.0 END AS DOUBLE) AS score
FROM part WHERE {_has("p_name", "small")} OR {_has("p_type", "small")} OR {_has("p_name", "gizmo")}""")
def rank_attribute(spark, sf_dir):
    """A word found in the second attribute only weighs less."""
    parts = table(spark, sf_dir, "part")
    rows = postings.postings(parts, [("p_name", S.STRING), ("p_type", S.STRING)], "p_partkey")
    query = parse_query("small gizmo", TWO)
    found = matching.matching_documents(parts.withColumnRenamed("p_partkey", "doc_id"), rows, postings.vocabulary(rows), query, TWO)
    return found.select(F.col("doc_id").alias("p_partkey"), F.round(ranking.rule("attribute", query, TWO), 5).alias("score"))


@register("score_threshold", f"{_match_sql(parse_query(_RANKED, CONFIG), 'any')} SELECT doc_id FROM found WHERE {_score_sql(parse_query(_RANKED, CONFIG))} >= 0.8")
def score_threshold(spark, sf_dir):
    query = parse_query(_RANKED, CONFIG)
    return matched(spark, sf_dir, query).where(ranking.score(query, CONFIG) >= 0.8).select("doc_id")


@register("top_hits", f"{_match_sql(parse_query(_RANKED, CONFIG), 'any')} SELECT doc_id, round({_score_sql(parse_query(_RANKED, CONFIG))}, 5) AS score FROM found ORDER BY score DESC, doc_id LIMIT 20")
def top_hits(spark, sf_dir):
    """The page of 20 hits is the feature."""
    query = parse_query(_RANKED, CONFIG)
    rows = matched(spark, sf_dir, query).select("doc_id", F.round(ranking.score(query, CONFIG), 5).alias("score"))
    return paging.page(rows, [F.col("score").desc()], 20)


@register("search_filtered_facets", f"""{_match_sql(parse_query("onend thernding of", CONFIG), 'any')}, f AS (SELECT * FROM found WHERE n_chars > 500 AND lang IN ('en', 'de'))
SELECT 'lang' AS attribute, lang AS value, count(*) AS count FROM f GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY source""")
def search_filtered_facets(spark, sf_dir):
    rows = matched(spark, sf_dir, parse_query("onend thernding of", CONFIG))
    kinds = {"lang": S.STRING, "source": S.STRING, "n_chars": S.NUMBER}
    kept = rows.where(compile_filter(parse("n_chars > 500 AND lang IN ('en', 'de')", CONFIG.filterable), kinds))
    return facets.distribution(kept, {"lang": S.STRING, "source": S.STRING})


# filters

PART = {"p_partkey": S.NUMBER, "p_name": S.STRING, "p_brand": S.STRING, "p_type": S.STRING, "p_size": S.NUMBER, "p_retailprice": S.NUMBER}


def part_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without the sizes 1 to 9 and with empty types for sizes over 40."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return p.withColumn("p_type", F.when(F.col("p_size") > 40, "").otherwise(F.col("p_type"))).withColumn("p_size", F.when(F.col("p_size") >= 10, F.col("p_size")).cast("double"))


PART_SQL = "SELECT p_partkey FROM (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 40 THEN '' ELSE p_type END AS p_type, CASE WHEN p_size >= 10 THEN p_size END AS p_size, p_retailprice FROM part) x WHERE "
FILTERS = {
    "filter_eq": ("p_size = 15", "p_size IS NOT DISTINCT FROM 15"),
    "filter_neq": ("p_size != 15", "p_size IS DISTINCT FROM 15"),
    "filter_in": ("p_size IN (10, 20, 30)", "coalesce(p_size IN (10, 20, 30), FALSE)"),
    "filter_not_in": ("p_size NOT IN (10, 20, 30)", "NOT coalesce(p_size IN (10, 20, 30), FALSE)"),
    "filter_greater": ("p_size > 30", "p_size > 30"),
    "filter_greater_equal": ("p_size >= 30", "p_size >= 30"),
    "filter_less": ("p_size < 30", "p_size < 30"),
    "filter_less_equal": ("p_retailprice <= 940.5", "p_retailprice <= 940.5"),
    "filter_between": ("p_size BETWEEN 30 AND 12", "p_size BETWEEN 12 AND 30"),
    "filter_not_between": ("p_size NOT BETWEEN 12 AND 30", "NOT coalesce(p_size BETWEEN 12 AND 30, FALSE)"),
    "filter_is_null": ("p_size IS NULL", "p_size IS NULL"),
    "filter_is_not_null": ("p_size IS NOT NULL", "p_size IS NOT NULL"),
    "filter_is_empty": ("p_type IS EMPTY", "p_type = ''"),
    "filter_is_not_empty": ("p_type IS NOT EMPTY", "p_type IS DISTINCT FROM ''"),
    "filter_string": ("p_brand = 'Brand#12' OR p_name = 'it''s'", "p_brand = 'Brand#12' OR p_name = 'it''s'"),
    "filter_from_the_left": ("p_size = 10 OR p_size > 20 AND p_retailprice > 940", "(p_size = 10 OR coalesce(p_size > 20, FALSE)) AND p_retailprice > 940"),
    "filter_group": ("p_size = 10 OR (p_size > 20 AND p_retailprice > 940)", "p_size = 10 OR (p_size > 20 AND p_retailprice > 940)"),
}


def _filter(text: str) -> Build:
    def build(spark, sf_dir):
        return part_with_nulls(spark, sf_dir).where(compile_filter(parse(text, PART), PART)).select("p_partkey")

    return build


for _name, (_text, _sql) in FILTERS.items():
    register(_name, PART_SQL + _sql)(_filter(_text))


@register("filter_primary_key", "SELECT p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) IN ('7', '70')")
def filter_primary_key(spark, sf_dir):
    return table(spark, sf_dir, "part").where(compile_filter(parse("p_partkey IN (7, '70')", PART), PART, "p_partkey")).select("p_partkey")


@register("filter_boolean", "SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1")
def filter_boolean(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("quality"))
    return rows.where(compile_filter(parse("toxic = true AND quality != false", ("toxic", "quality")), {"toxic": S.BOOLEAN, "quality": S.BOOLEAN})).select("doc_id")


@register("filter_unknown_attribute", "SELECT p_partkey FROM part")
def filter_unknown_attribute(spark, sf_dir):
    return table(spark, sf_dir, "part").where(compile_filter(parse("nowhere != 3", ("nowhere",)), PART)).select("p_partkey")


ORDER_SQL = "WITH o AS (SELECT l_orderkey, list(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY l_orderkey) "
ORDER = {"q": S.NUMBERS}


def order_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("q"))


for _name, _text, _sql in (
    ("multi_exists", "q > 48", "len(list_filter(q, lambda x: x > 48)) > 0"),
    ("multi_not_exists", "q NOT IN (10, 20, 30)", "len(list_filter(q, lambda x: x IN (10, 20, 30))) = 0"),
    ("multi_not_between", "q NOT BETWEEN 10 AND 40", "len(list_filter(q, lambda x: x BETWEEN 10 AND 40)) = 0"),
    ("multi_separate_predicates", "q < 3 AND q > 48", "len(list_filter(q, lambda x: x < 3)) > 0 AND len(list_filter(q, lambda x: x > 48)) > 0"),
):
    register(_name, f"{ORDER_SQL}SELECT l_orderkey FROM o WHERE {_sql}")(lambda spark, sf_dir, text=_text: order_quantities(spark, sf_dir).where(compile_filter(parse(text, ORDER), ORDER)).select("l_orderkey"))


def _order_sort(spark, sf_dir, entry: str, text: str) -> tuple[DataFrame, list[Column]]:
    config = IndexConfig(primary_key="l_orderkey", filterable=("q",), sortable=("q",))
    tree = parse(text, ORDER)
    rows = order_quantities(spark, sf_dir).where(compile_filter(tree, ORDER))
    return rows, order_columns(parse_sort((entry,), config), ORDER, config, tree, None)


@register("multi_min_sort", f"{ORDER_SQL}SELECT l_orderkey, list_min(q) AS least FROM o ORDER BY least, l_orderkey LIMIT 100")
def multi_min_sort(spark, sf_dir):
    """The page of 100 is the feature."""
    rows, order = _order_sort(spark, sf_dir, "min(q):asc", "")
    return paging.page(rows, order, 100, 0, "l_orderkey").select("l_orderkey", F.array_min("q").alias("least"))


@register("multi_max_sort_filtered", f"{ORDER_SQL}SELECT l_orderkey, list_max(list_filter(q, lambda x: x < 20)) AS most FROM o WHERE len(list_filter(q, lambda x: x < 20)) > 0 ORDER BY most DESC, l_orderkey LIMIT 100")
def multi_max_sort_filtered(spark, sf_dir):
    """The page of 100 is the feature."""
    rows, order = _order_sort(spark, sf_dir, "max(q):desc", "q < 20")
    return paging.page(rows, order, 100, 0, "l_orderkey").select("l_orderkey", F.array_max(F.filter("q", lambda x: x < 20)).alias("most"))


# locations: customers spread over the globe by their keys

PLACES_SQL = "WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey * 37 % 170 AS DOUBLE) - 85 END AS lat, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey * 101 % 359 AS DOUBLE) - 179 END AS lng FROM customer) "
DISTANCE_SQL = "CASE WHEN lat IS NOT NULL THEN 2 * 6371008.77 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(52.52)) / 2), 2) + cos(radians(lat)) * cos(radians(52.52)) * pow(sin((radians(lng) - radians(13.405)) / 2), 2)))) END"
PLACE = {"place": S.GEO}


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a location; those in debt have none."""
    key = F.col("c_custkey")
    where = F.struct(((key * 37 % 170).cast("double") - 85).alias("lat"), ((key * 101 % 359).cast("double") - 179).alias("lng"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, where).alias("place"))


@register("geo_radius", f"{PLACES_SQL}SELECT c_custkey FROM c WHERE {DISTANCE_SQL} <= 3000000")
def geo_radius(spark, sf_dir):
    return places(spark, sf_dir).where(compile_filter(parse("_geoRadius(place, 52.52, 13.405, 3000000)", PLACE), PLACE)).select("c_custkey")


@register("geo_box", f"{PLACES_SQL}SELECT c_custkey FROM c WHERE lat BETWEEN -20 AND 50 AND lng BETWEEN -30 AND 60")
def geo_box(spark, sf_dir):
    return places(spark, sf_dir).where(compile_filter(parse("_geoBoundingBox(place, 50, 60, -20, -30)", PLACE), PLACE)).select("c_custkey")


@register("geo_distance", f"{PLACES_SQL}SELECT c_custkey, CAST(round({DISTANCE_SQL}) AS BIGINT) AS metres FROM c")
def geo_distance(spark, sf_dir):
    metres = F.round(geo.distance(F.col("place.lat"), F.col("place.lng"), 52.52, 13.405)).cast("bigint")
    return places(spark, sf_dir).select("c_custkey", metres.alias("metres"))


@register("geo_sort", f"{PLACES_SQL}SELECT c_custkey FROM c ORDER BY {DISTANCE_SQL} NULLS LAST, c_custkey LIMIT 50")
def geo_sort(spark, sf_dir):
    """The page of 50 is the feature."""
    config = IndexConfig(primary_key="c_custkey", sortable=("place",))
    order = order_columns(parse_sort(("_geoPoint(place, 52.52, 13.405):asc",), config), PLACE, config, parse("", ()), None)
    return paging.page(places(spark, sf_dir), order, 50, 0, "c_custkey").select("c_custkey")


# facets

@register("facet_single", "SELECT 'lang' AS attribute, lang AS value, count(*) AS count FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_single(spark, sf_dir):
    return facets.distribution(table(spark, sf_dir, "documents"), {"lang": S.STRING, "source": S.STRING})


@register("facet_multi", f"{ORDER_SQL}, v AS (SELECT DISTINCT l_orderkey, unnest(q) AS x FROM o) SELECT 'q' AS attribute, CAST(x AS VARCHAR) AS value, count(*) AS count FROM v GROUP BY x")
def facet_multi(spark, sf_dir):
    return facets.distribution(order_quantities(spark, sf_dir), {"q": S.NUMBERS})


@register("facet_limit", "SELECT 'p_brand' AS attribute, p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 7")
def facet_limit(spark, sf_dir):
    """The limit on the values of a facet is the feature."""
    return facets.distribution(table(spark, sf_dir, "part"), {"p_brand": S.STRING}, 7)


@register("facet_min_max", f"{ORDER_SQL}SELECT 'q' AS attribute, min(list_min(q)) AS min, max(list_max(q)) AS max FROM o")
def facet_min_max(spark, sf_dir):
    return facets.stats(order_quantities(spark, sf_dir), ORDER)


@register("facet_min_max_single", "SELECT 'p_retailprice' AS attribute, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part UNION ALL SELECT 'p_size', min(p_size), max(p_size) FROM part WHERE p_size >= 10")
def facet_min_max_single(spark, sf_dir):
    return facets.stats(part_with_nulls(spark, sf_dir), {"p_retailprice": S.NUMBER, "p_size": S.NUMBER, "p_type": S.STRING})


# distinct, order, pages

@register("distinct_best", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def distinct_best(spark, sf_dir):
    return paging.distinct_best(table(spark, sf_dir, "documents"), "source", [F.col("n_chars").desc_nulls_last()]).select("doc_id", "source")


@register("distinct_nulls", "SELECT p_partkey, p_size FROM (SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size END AS p_size, p_retailprice FROM part) x QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) = 1")
def distinct_nulls(spark, sf_dir):
    return paging.distinct_best(part_with_nulls(spark, sf_dir), "p_size", [F.col("p_retailprice").asc_nulls_last()], "p_partkey").select("p_partkey", "p_size")


def _part_places(entry: str) -> Build:
    """The place of every row in the order."""

    def build(spark, sf_dir):
        config = IndexConfig(primary_key="p_partkey", sortable=("p_size", "p_type", "p_retailprice"))
        order = order_columns(parse_sort((entry,), config), PART, config, parse("", ()), None)
        return paging.numbered(part_with_nulls(spark, sf_dir), order, "p_partkey").select("p_partkey", "place")

    return build


def _part_page(entry: str, limit: int, offset: int) -> Build:
    def build(spark, sf_dir):
        config = IndexConfig(primary_key="p_partkey", sortable=("p_size", "p_type", "p_retailprice"))
        order = order_columns(parse_sort((entry,), config), PART, config, parse("", ()), None)
        return paging.page(part_with_nulls(spark, sf_dir), order, limit, offset, "p_partkey").select("p_partkey")

    return build


PART_ROWS_SQL = PART_SQL.removesuffix(" WHERE ")
register("sort_nulls_last", PART_ROWS_SQL.replace("SELECT p_partkey", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_partkey) AS place", 1))(_part_places("p_size:desc"))
register("sort_nulls_last_ascending", PART_ROWS_SQL.replace("SELECT p_partkey", "SELECT p_partkey, row_number() OVER (ORDER BY p_size ASC NULLS LAST, p_partkey) AS place", 1))(_part_places("p_size:asc"))
register("sort_empty_last", PART_ROWS_SQL.replace("SELECT p_partkey", "SELECT p_partkey, row_number() OVER (ORDER BY p_type IS NULL, p_type = '', p_type, p_partkey) AS place", 1))(_part_places("p_type:asc"))
register("page_offset", f"{PART_ROWS_SQL} ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25 OFFSET 50")(_part_page("p_retailprice:desc", 25, 50))


@register("sort_by_text_key", "SELECT p_partkey FROM part ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 100")
def sort_by_text_key(spark, sf_dir):
    """The page of 100 is the feature."""
    return _part_page("p_partkey:asc", 100, 0)(spark, sf_dir)


@register("total_hits_capped", "SELECT least(150, count(*)) AS total FROM documents WHERE n_chars > 100")
def total_hits_capped(spark, sf_dir):
    index = meta_index(spark, sf_dir, max_total_hits=150)
    return _values(spark, [(index.search(SearchParams(filter="n_chars > 100", limit=1)).total_hits,)], "total bigint")


# indexes: what goes through documents in and out

def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def meta_index(spark: SparkSession, sf_dir: str, **more) -> SearchIndex:
    """The documents' columns but the text, which isn't needed here."""
    index = SearchIndex(spark, IndexConfig(primary_key="key", searchable=("source",), filterable=("lang", "source", "n_chars"), sortable=("n_chars",), typo=TypoTolerance(enabled=False), **more))
    index.add(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "source", "n_chars"))
    return index


def part_index(spark: SparkSession, sf_dir: str, **more) -> SearchIndex:
    index = SearchIndex(spark, TWO.with_(filterable=("p_size", "p_brand"), sortable=("p_size",), **more))
    index.add(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return index


def shown(hits: DataFrame) -> Column:
    """The names of the hits' attributes."""
    return F.lit(",".join(sorted(hits.columns))).alias("shown")


@register("browse_filtered", "SELECT doc_id AS key, lang FROM documents WHERE lang = 'en' AND source IS DISTINCT FROM 'src1'")
def browse_filtered(spark, sf_dir):
    return meta_index(spark, sf_dir).every_hit(BrowseParams(filter="lang = 'en' AND source != 'src1'", retrieve=("key", "lang")))


@register("project_attributes", "SELECT doc_id AS key, 'key,source' AS shown, source FROM documents")
def project_attributes(spark, sf_dir):
    """Hits have the attributes that are asked for, and no others."""
    hits = meta_index(spark, sf_dir).every_hit(BrowseParams(retrieve=("key", "source")))
    return hits.select("key", shown(hits), "source")


@register("displayed_attributes", "SELECT p_partkey, 'p_name,p_partkey' AS shown FROM part")
def displayed_attributes(spark, sf_dir):
    """What isn't displayed is searched and filtered by, and no hit has it."""
    hits = part_index(spark, sf_dir, displayed=("p_name",)).every_hit(BrowseParams(filter="p_size IS NOT NULL"))
    return hits.select("p_partkey", shown(hits))


@register("search_on_one_attribute", f"SELECT p_partkey FROM part WHERE {_has('p_type', 'small')}")
def search_on_one_attribute(spark, sf_dir):
    return part_index(spark, sf_dir).every_hit(BrowseParams(query="small", search_on=("p_type",))).select("p_partkey")


@register("stop_words_of_a_query", f"SELECT p_partkey FROM part WHERE {_has('p_name', 'gizmo')} UNION ALL SELECT -p_partkey - 1 FROM part WHERE {_has('p_name', 'small')} OR {_has('p_type', 'small')}")
def stop_words_of_a_query(spark, sf_dir):
    """A stop word of a query doesn't count, unless the query has nothing else: such hits have negative numbers here."""
    index = part_index(spark, sf_dir, stop_words=("small",))
    alone = index.every_hit(BrowseParams(query="small")).select((-F.col("p_partkey") - 1).alias("p_partkey"))
    return index.every_hit(BrowseParams(query="small gizmo")).select("p_partkey").unionByName(alone)


@register("query_token_limit", f"SELECT p_partkey, 'nothing red \"blue\"' AS query FROM part WHERE {_has('p_name', 'red')} OR {_has('p_name', 'blue')}")
def query_token_limit(spark, sf_dir):
    """Words beyond the limit don't count, and the query that is given back ends before them, its phrase closed."""
    index, text = part_index(spark, sf_dir, max_query_tokens=3), 'nothing red "blue bolt" gizmo'
    return index.every_hit(BrowseParams(query=text)).select("p_partkey", F.lit(index.search(SearchParams(query=text)).query).alias("query"))


@register("upsert_changed", "SELECT p_partkey FROM part WHERE p_size > 25")
def upsert_changed(spark, sf_dir):
    """The documents that a second version of the table replaces: those that have changed."""
    index = part_index(spark, sf_dir)
    before = {r["p_partkey"]: r["doc_id"] for r in index.documents.collect()}
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    index.add(parts.withColumn("p_name", F.when(F.col("p_size") > 25, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))))
    changed = [(r["p_partkey"],) for r in index.documents.collect() if before.get(r["p_partkey"]) != r["doc_id"]]
    return _values(spark, changed, "p_partkey bigint")


@register("delete_by_key", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def delete_by_key(spark, sf_dir):
    index = part_index(spark, sf_dir)
    index.delete([r[0] for r in table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey").distinct().collect()])
    return index.documents.select("p_partkey")


@register("orphan_terms", f"WITH {POSTINGS_SQL} SELECT term FROM vocab EXCEPT SELECT DISTINCT term FROM post JOIN documents USING (doc_id) WHERE lang <> 'es'")
def orphan_terms(spark, sf_dir):
    """Terms that go when the Spanish documents do."""
    index = SearchIndex(spark, IndexConfig(primary_key="key", searchable=("text",), filterable=("lang",), typo=TypoTolerance(enabled=False)))
    index.add(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "lang"))
    before = index.store.read("vocabulary").select("term")
    index.delete_where("lang = 'es'")
    return before.join(index.store.read("vocabulary"), "term", "left_anti")


@register("count_documents", "SELECT count(*) AS n FROM documents")
def count_documents(spark, sf_dir):
    return _values(spark, [(meta_index(spark, sf_dir).count(),)], "n bigint")


@register("schema_evolution", "SELECT p_partkey AS key, p_name AS name, NULL AS comment FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def schema_evolution(spark, sf_dir):
    """Documents with another attribute are added, and replace those with their keys."""
    index = SearchIndex(spark, IndexConfig(primary_key="key", searchable=("name", "comment"), typo=TypoTolerance(enabled=False)))
    index.add(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")))
    index.add(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("comment")))
    return index.documents.select("key", "name", "comment")


@register("typo_prefix_optional", None)
def typo_prefix_optional(spark, sf_dir):
    """Typos within a prefix, which are off by default. No SQL: the distance runs over every prefix of a term."""
    config = CONFIG.with_(typo=TypoTolerance(for_prefixes=True))
    return matching.term_matches(postings.vocabulary(documents_postings(spark, sf_dir)), parse_query("of thernd", config).tokens, config)
