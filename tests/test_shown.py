"""What hits show, parameters and their forms, languages, and scans that skip."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrove.config import IndexConfig, TypoTolerance
from lexigrove.engine import SearchIndex
from lexigrove.errors import InvalidJson, InvalidSearchParameters
from lexigrove.functions.language import LANGUAGES, Detector, detect, detect_attributes, given
from lexigrove.operators import formatting, matching
from lexigrove.operators.paging import numbered
from lexigrove.params import BrowseParams, SearchParams, escape_filter_value
from lexigrove.plans.query import parse_query, with_stems

TEXT = "At dawn the otter swims upstream. Nobody sees it leave. Later, far below the weir, a second otter waits for the first otter to return."


@pytest.fixture(scope="module")
def animals(spark):
    index = SearchIndex(spark, IndexConfig(searchable=("title", "text"), filterable=("year",), displayed=("title", "text", "year"), languages=("en",)))
    index.add([{"id": 1, "title": "Otters", "text": TEXT, "year": 2001, "secret": "hidden heron"}, {"id": 2, "title": "A heron", "text": "It stands still.", "year": None, "secret": "x"}])
    return index


def test_displayed_and_retrieved(animals):
    hit = animals.search(SearchParams(query="heron")).hits[0]
    assert hit == {"id": 2, "title": "A heron", "text": "It stands still.", "year": None}
    assert animals.search(SearchParams(query="hidden")).total_hits == 0
    assert animals.search(SearchParams(query="heron", retrieve=("title", "secret", "nothing"))).hits == [{"title": "A heron"}]
    assert animals.get(1) == {"id": 1, "title": "Otters", "text": TEXT, "year": 2001}


def test_attributes_to_search_on(animals):
    assert [h["id"] for h in animals.search(SearchParams(query="otter", search_on=("text",))).hits] == [1]
    assert animals.search(SearchParams(query="weir", search_on=("title",))).total_hits == 0
    assert animals.search(SearchParams(query="weir", search_on=("title", "text"))).total_hits == 1
    shown = animals.search(SearchParams(query="otter", search_on=("text",), highlight=("title", "text"), show_positions=True)).hits[0]
    assert shown["_formatted"]["title"] == "Otters" and set(shown["_matchesPosition"]) == {"text"}


def test_highlight_of_what_is_not_retrieved(animals):
    hit = animals.search(SearchParams(query="heron", retrieve=("id",), highlight=("title",))).hits[0]
    assert hit == {"id": 2, "_formatted": {"id": 2, "title": "A <em>heron</em>"}}
    hit = animals.search(SearchParams(query="heron", retrieve=("id",), highlight=("title",), highlight_start="[", highlight_end="]")).hits[0]
    assert hit["_formatted"]["title"] == "A [heron]"


def test_crop(animals):
    hit = animals.search(SearchParams(query="otter", crop={"text": 20}, highlight=("text",))).hits[0]
    text = hit["_formatted"]["text"]
    plain = text.replace("<em>", "").replace("</em>", "")
    assert text.count("<em>otter</em>") == 3 and plain.startswith("…") and plain.count("…") >= 2
    assert all(part in TEXT for part in plain.split("…")) and len(plain) < len(TEXT)
    assert hit["text"] == TEXT
    without = animals.search(SearchParams(query="heron", crop=("text",), crop_length=8, crop_marker="~")).hits[0]["_formatted"]["text"]
    assert without.startswith("It stands") and without.endswith("~")


def test_crop_of_the_densest(animals):
    spans = [(i, i + 5, n) for i, n in ((3, 1), (203, 3), (403, 2))]
    text = ("x" * 2 + " match" + "y" * 191 + " ") * 4
    best = formatting.crop(text, spans, 10, "|", 2, True)
    first = formatting.crop(text, spans, 10, "|", 2, False)
    assert best != first and best.startswith("|") and not first.startswith("|")


def test_parameters_there_and_back():
    p = SearchParams(query='a "b', filter="x = 1", retrieve=["a"], facets=("f",), crop=("t",), crop_length=7, page=2, hits_per_page=5, score_threshold=0.5)
    assert SearchParams.from_json(p.to_json()) == p and p.crop == {"t": 7} and p.window() == (5, 5)
    assert SearchParams.from_dict(p.to_dict()) == p and BrowseParams.from_json(BrowseParams(query="q").to_json()) == BrowseParams(query="q")
    assert p.hash() == p.with_(facets=(), sort=("x:asc",), score_threshold=0.0, distinct="d").hash() != p.with_(query="other").hash()
    with pytest.raises(InvalidJson):
        SearchParams.from_json("{")
    with pytest.raises(InvalidSearchParameters):
        SearchParams(matching_strategy="some")
    config = IndexConfig(searchable=("a",), typo=TypoTolerance(thresholds={4: 1}))
    assert IndexConfig.from_dict(config.to_dict()) == config


@pytest.mark.parametrize("value,text", [("it's", "'it''s'"), (True, "true"), (False, "false"), (3, "3"), (2.5, "2.5"), ("", "''")])
def test_escaped_values(value, text):
    assert escape_filter_value(value) == text


def test_an_escaped_value_is_found(spark):
    index = SearchIndex(spark, IndexConfig(filterable=("name",)))
    index.add([{"id": 1, "name": "it's ' OR name != '"}, {"id": 2, "name": "other"}])
    assert [h["id"] for h in index.search(SearchParams(filter=f"name = {escape_filter_value(chr(105) + 't' + chr(39) + 's ' + chr(39) + ' OR name != ' + chr(39))}")).hits] == [1]


def test_stop_words_and_limits_of_a_query():
    config = IndexConfig(stop_words=("the", "of"), max_query_tokens=3)
    assert [t.term for t in parse_query("the lord of rings", config).tokens] == ["lord"]
    assert [t.term for t in parse_query("of the", config).tokens] == ["of", "the"]
    q = parse_query('one "two three four" five', config)
    assert [t.term for t in q.tokens] == ["one", "two", "three"] and q.analysed == 'one "two three"'


def test_result_as_dict(animals):
    d = animals.search(SearchParams(query="heron", facets=("year",))).to_dict()
    assert {"hits", "query", "hitsPerPage", "page", "totalPages", "totalHits", "facetDistribution", "facetStats"} == set(d) and d["totalHits"] == 1


def test_query_words_match_their_stems(spark):
    index = SearchIndex(spark, IndexConfig(searchable=("text",), languages=("en",)))
    index.add([{"id": 1, "text": "the relation between them"}, {"id": 2, "text": "something else"}])
    assert [h["id"] for h in index.search(SearchParams(query="relational now")).hits] == [1]
    assert index.search(SearchParams(query='"relational"')).total_hits == 0
    tokens = with_stems(parse_query("houses und", IndexConfig()), "en").tokens
    assert tokens[0].stems and not tokens[1].stems


def test_typos_are_counted_only_where_a_rule_needs_them(spark):
    vocab = spark.createDataFrame([("lantern", 7), ("lantarn", 7)], "term string, length int")
    tokens = parse_query("lantern", IndexConfig()).tokens
    for count in (True, False):
        found, terms = matching.known_matches(vocab, tokens, IndexConfig(), count)
        assert {(r["term"], r["typos"]) for r in found.collect()} == {("lantern", 0), ("lantarn", int(count))} and terms == ["lantarn", "lantern"]


def test_many_terms_stay_a_table(spark, monkeypatch):
    vocab = spark.range(300).selectExpr("concat('lamp', id) as term", "cast(length(concat('lamp', id)) as int) as length")
    tokens = parse_query("lamp", IndexConfig()).tokens
    known, terms = matching.known_matches(vocab, tokens, IndexConfig())
    monkeypatch.setattr(matching, "MOST_TERMS", 10)
    table, none = matching.known_matches(vocab, tokens, IndexConfig())
    assert none is None and len(terms) == 300 and sorted(map(tuple, table.collect())) == sorted(map(tuple, known.collect()))


def test_terms_reach_the_scan(spark, tmp_path):
    """The postings' scan reads the row groups of the terms alone."""
    index = SearchIndex(spark, IndexConfig(searchable=("text",), typo=TypoTolerance(enabled=False)), str(tmp_path / "index"))
    index.add(spark.range(2_000).selectExpr("id", "concat('alpha', id, ' beta', id, ' gamma') as text"))
    for query in ("alpha17 ", "alpha1"):  # the second is the beginning of many
        matches = index.search(SearchParams(query=query)).matches
        plan = matches._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "In(term" in plan or "EqualTo(term" in plan or "Or(" in plan
    some = matching.having_terms(index.store.read("postings"), [f"alpha{i}" for i in range(25)])
    assert "PushedFilters: [Or(Or(In(term, [alpha0,alpha1" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 25


def test_languages():
    for lang, text in {"en": "where is the house that was built", "de": "wo ist das Haus, das gebaut wurde", "fr": "où est la maison qui est dans la rue", "es": "dónde está la casa que hay en la calle", "it": "dove è la casa che si trova nella strada", "nl": "waar is het huis dat gebouwd werd", "sv": "var är huset som ligger vid vägen", "pt": "onde está a casa que não é dele"}.items():
        assert detect(text, reliable=False) == lang and lang in LANGUAGES
    assert detect("", reliable=False) is detect(None) is detect("12 34") is None
    assert detect("und der die", ("en", "fr"), False) in ("en", "fr")
    document, each = given().detect_document(["Kiosk", "Das ist ein langer Text über die Häuser der Stadt", "", "The weather is what it was when they had it"])
    assert document in ("de", "en") and each[1] == "de" and each[2] is None and each[3] == "en" and each[0] is not None


def test_language_of_attributes(spark):
    df = spark.createDataFrame([("der Hund und die Katze sind nicht hier", "the dog and the cat are not here", None)], "a string, b string, c string")
    assert df.select(detect_attributes([F.col("a"), F.col("b"), F.col("c")]).alias("l")).first()["l"] == ["de", "en", None]
    index = SearchIndex(spark, IndexConfig(searchable=("a", "b"), languages=("de", "en")))
    index.add([{"id": 1, "a": "die Häuser und die Kinder sind hier in der Stadt", "b": "the hopeful runners were running to the houses"}])
    terms = {r["term"] for r in index.store.read("vocabulary").collect()}
    assert "hope" in terms and "run" in terms  # English stems of b though a is German


def test_trained_profiles(spark):
    rows = [("aa ab ba " * 5, "x"), ("zz zy yz " * 5, "y"), (None, "x"), ("aaa", None)] * 3
    d = Detector.train(spark.createDataFrame(rows, "text string, lang string"))
    assert d.languages == ("x", "y") and d.detect("ab aa") == "x" and d.detect("zy zz") == "y"


def test_places(spark):
    df = spark.range(1_000).selectExpr("id as doc_id", "pmod(id * 37, 101) as v")
    got = {r["doc_id"]: r["place"] for r in numbered(df, [F.col("v").desc()]).collect()}
    want = sorted(((-(i * 37 % 101), i) for i in range(1_000)))
    assert got == {i: k + 1 for k, (_, i) in enumerate(want)}
