"""Searches over small indexes: matching, filters, ranking, facets, order, pages and changes."""

from __future__ import annotations

import math

import pytest

from lexigrove.config import IndexConfig, TypoTolerance
from lexigrove.engine import SearchIndex
from lexigrove.errors import FilterFormatError, InvalidDocument, InvalidSearchParameters, PrimaryKeyNotFound, SortFormatError
from lexigrove.params import SearchParams, BrowseParams

STAFF = [
    {"id": 1, "name": "Hanna Oberlander", "team": ["Press", "Sales"], "gender": "f", "age": 41, "active": True, "marks": [2.5, 4.0]},
    {"id": 2, "name": "Ugo Treviso", "team": ["Sales"], "gender": "m", "age": 19, "active": True, "marks": [1.0]},
    {"id": 3, "name": "Blaubeerin Kessler-Höhn", "team": [], "gender": "", "age": 63, "active": True, "marks": []},
    {"id": 4, "name": "Jörg Blaubeerfeld", "team": ["Garden", "Press"], "gender": "m", "age": 30, "active": False, "marks": [5.0, 3.5]},
    {"id": 5, "name": "Sixten Ahlgren", "team": None, "gender": None, "age": 52, "active": False, "marks": [4.5]},
]


def ids(result):
    return [h["id"] for h in result.hits]


@pytest.fixture(scope="module")
def staff(spark):
    index = SearchIndex(spark, IndexConfig(searchable=("name",), filterable=("team", "gender", "age", "active", "marks"), sortable=("name", "age", "marks")))
    index.add(STAFF)
    return index


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("gender = 'm'", [2, 4]),
        ("gender != 'm'", [1, 3, 5]),
        ("gender IN ('m', 'f')", [1, 2, 4]),
        ("gender NOT IN ('m')", [1, 3, 5]),
        ("gender IS NULL", [5]),
        ("gender IS NOT NULL", [1, 2, 3, 4]),
        ("gender IS EMPTY", [3]),
        ("gender IS NOT EMPTY", [1, 2, 4, 5]),
        ("age > 41", [3, 5]),
        ("age >= 41", [1, 3, 5]),
        ("age BETWEEN 52 AND 30", [1, 4, 5]),
        ("age NOT BETWEEN 30 AND 52", [2, 3]),
        ("active = true", [1, 2, 3]),
        ("team = 'Press'", [1, 4]),
        ("team != 'Press'", [2, 3, 5]),
        ("team IN ('Garden', 'Sales')", [1, 2, 4]),
        ("team NOT IN ('Garden', 'Sales')", [3, 5]),
        ("team IS EMPTY", [3]),
        ("team IS NULL", [5]),
        ("team IS NOT EMPTY", [1, 2, 4, 5]),
        ("marks > 4", [4, 5]),
        ("marks BETWEEN 1 AND 2", [2]),
        ("marks NOT BETWEEN 1 AND 2", [1, 3, 4, 5]),
        ("age < 20 OR age > 60 AND active = true", [2, 3]),
        ("gender = 'f' OR gender = 'm' AND age < 35", [2, 4]),
        ("gender = 'f' OR (gender = 'm' AND age < 35)", [1, 2, 4]),
        ("() ", [1, 2, 3, 4, 5]),
    ],
)
def test_filters(staff, text, expected):
    assert ids(staff.search(SearchParams(filter=text))) == expected


@pytest.mark.parametrize("text", ["name = 'x'", "age >", "(age = 1", "age = 1)", "team IN 'a'", "age = -5", "age BETWEEN 'a' AND 'b'", "$", "age NOT 4", "age IS foo"])
def test_filter_errors(staff, text):
    with pytest.raises(FilterFormatError, match=r"Col \d+: Error: Expected"):
        staff.search(SearchParams(filter=text))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("blaubeerin", [3]),
        ("blaubeer", [3, 4]),  # the last word matches what begins so
        ("blaubeer treviso", [2]),  # not the last
        ("Blaubeirn", [3]),  # neighbours swapped
        ("Glaubeerin", [3]),  # a first letter counts twice, two are allowed
        ("hohn", [3]),
        ("jorg", [4]),
        ("jörg", [4]),
        ('"ugo treviso"', [2]),
        ('"treviso ugo"', []),
        ("-ugo", [1, 3, 4, 5]),
        ("hanna -oberlander", []),
        ("zzzz", []),
    ],
)
def test_matching(staff, text, expected):
    assert sorted(ids(staff.search(SearchParams(query=text)))) == expected


def test_strategies(staff):
    assert sorted(ids(staff.search(SearchParams(query="hanna treviso")))) == [1, 2]
    assert ids(staff.search(SearchParams(query="hanna treviso", matching_strategy="all"))) == []
    assert ids(staff.search(SearchParams(query="treviso ugo", matching_strategy="all"))) == [2]


def test_order_nulls_last(staff):
    assert ids(staff.search(SearchParams(sort=("age:desc",)))) == [3, 5, 1, 4, 2]
    assert ids(staff.search(SearchParams(sort=("min(marks):asc",)))) == [2, 1, 4, 5, 3]
    assert ids(staff.search(SearchParams(sort=("max(marks):desc",)))) == [4, 5, 1, 2, 3]
    assert ids(staff.search(SearchParams(sort=("max(marks):desc",), filter="marks < 5"))) == [5, 1, 4, 2]
    with pytest.raises(SortFormatError):
        staff.search(SearchParams(sort=("gender:asc",)))
    with pytest.raises(SortFormatError):
        staff.search(SearchParams(sort=("age",)))


def test_facets(staff):
    r = staff.search(SearchParams(facets=("team", "gender", "age", "active", "marks", "name")))
    assert r.facet_distribution == {"team": {"Garden": 1, "Press": 2, "Sales": 2}, "gender": {"f": 1, "m": 2}, "age": {"19.0": 1, "30.0": 1, "41.0": 1, "52.0": 1, "63.0": 1}, "active": {"false": 2, "true": 3}, "marks": {"1.0": 1, "2.5": 1, "3.5": 1, "4.0": 1, "4.5": 1, "5.0": 1}}
    assert r.facet_stats == {"age": {"min": 19.0, "max": 63.0}, "marks": {"min": 1.0, "max": 5.0}}
    few = staff.search(SearchParams(facets=("age",), max_values_per_facet=2, limit=1, offset=4))
    assert few.facet_distribution == {"age": {"19.0": 1, "30.0": 1}} and few.total_hits == 5


def test_distinct_and_pages(staff):
    assert ids(staff.search(SearchParams(distinct="gender", sort=("age:desc",)))) == [3, 5, 1, 4]
    with pytest.raises(InvalidSearchParameters):
        staff.search(SearchParams(distinct="team"))
    r = staff.search(SearchParams(limit=2, offset=2))
    assert (ids(r), r.page, r.total_pages, r.total_hits) == ([3, 4], 2, 3, 5)
    r = staff.search(SearchParams(page=3, hits_per_page=2))
    assert (ids(r), r.page, r.total_pages) == ([5], 3, 3)
    with pytest.raises(InvalidSearchParameters):
        SearchParams(limit=1001)


def test_browse_is_not_capped(spark):
    index = SearchIndex(spark, IndexConfig(max_total_hits=3))
    index.add([{"id": i, "t": "word"} for i in range(8)])
    assert index.browse(BrowseParams(query="word")).total_hits == 8
    assert index.search(SearchParams(query="word")).total_hits == 3
    assert len(index.search(SearchParams(query="word", limit=10, offset=2)).hits) == 3


def test_scores(spark):
    """Sums of the five rules, worked out by hand."""
    index = SearchIndex(spark, IndexConfig(searchable=("title", "body"), languages=("en",), typo=TypoTolerance(enabled=False)))
    index.add([{"id": 1, "title": "aa bb", "body": "cc"}, {"id": 2, "title": "zz", "body": "aa xx xx xx xx xx bb"}, {"id": 3, "title": "zz", "body": "aa"}, {"id": 4, "title": "aa", "body": "bb"}])
    r = index.search(SearchParams(query="aa bb", show_score=True))
    got = {h["id"]: h["_rankingScore"] for h in r.hits}
    weights = [0.7**i for i in range(5)]

    def mean(*rules):
        return round(sum(w * x for w, x in zip(weights, rules)) / sum(weights), 5)

    assert got == {
        1: mean(1, 1, 1, 1, 1),
        2: mean(1, 1, math.exp(-0.6), 0.8 * 0.8, 1),
        3: mean(0.5, 1, 1, 0.8, 0.5),
        4: mean(1, 1, 0.5, 0.8, 1),
    }
    assert ids(r) == [1, 4, 2, 3]
    assert set(ids(index.search(SearchParams(query="aa bb", score_threshold=0.9)))) == {i for i in got if got[i] >= 0.9}


def test_single_rules(spark):
    docs = [{"id": 1, "title": "aa bb", "body": "cc"}, {"id": 2, "title": "cc", "body": "aa bb"}, {"id": 3, "title": "cc", "body": "aa"}]
    for rule, expected in (("words", [1.0, 1.0, 0.5]), ("attribute", [1.0, 0.64, 0.8]), ("exactness", [1.0, 1.0, 0.5]), ("proximity", [1.0, 1.0, 1.0])):
        index = SearchIndex(spark, IndexConfig(searchable=("title", "body"), ranking_rules=(rule,)))
        index.add(docs)
        got = {h["id"]: h["_rankingScore"] for h in index.search(SearchParams(query="aa bb", show_score=True)).hits}
        assert [got[i] for i in (1, 2, 3)] == expected, rule


def test_geo(spark):
    index = SearchIndex(spark, IndexConfig(filterable=("place",), sortable=("place",)))
    index.add([{"id": "a", "place": {"lat": 51.5, "lng": -0.12}}, {"id": "b", "place": {"lat": 47.5, "lng": 19.05}}, {"id": "c", "place": {"lat": -33.86, "lng": 151.2}}, {"id": "d"}])
    near = SearchParams(filter="_geoRadius(place, 52.52, 13.405, 950000)", sort=("_geoPoint(place, 52.52, 13.405):asc",))
    r = index.search(near)
    assert ids(r) == ["b", "a"]
    assert [h["_geoDistance(place)"] for h in r.hits] == [688248, 931218]
    assert ids(index.search(SearchParams(filter="_geoBoundingBox(place, 55, 20, 40, -7)"))) == ["a", "b"]
    assert ids(index.search(SearchParams(filter="_geoBoundingBox(place, 55, -7, 40, 20)"))) == []
    assert ids(index.search(SearchParams(filter="_geoRadius(place, -33, 151, 200000)"))) == ["c"]
    assert ids(index.search(SearchParams(sort=("_geoPoint(place, 48, 16):desc",)))) == ["c", "a", "b", "d"]


def test_changes(spark, tmp_path):
    config = IndexConfig(searchable=("text",), filterable=("kind",))
    index = SearchIndex(spark, config, str(tmp_path / "index"))
    assert index.search(SearchParams(query="x")).total_hits == 0 and index.count() == 0 and index.get(1) is None
    with pytest.raises(PrimaryKeyNotFound):
        index.add([{"text": "no key"}])
    index.add([{"id": 1, "text": "green apple", "kind": "fruit"}, {"id": 2, "text": "red car", "kind": "thing"}])
    index.add([{"id": 2, "text": "blue bicycle", "kind": "thing"}, {"id": 3, "text": "yellow lemon", "kind": None, "extra": 4}])
    assert index.count() == 3 and index.size() > 0 and not index.needs_reindex()
    assert ids(index.search(SearchParams(query="car"))) == []
    assert ids(index.search(SearchParams(query="bicycle"))) == [2]
    assert index.get("3")["text"] == "yellow lemon"
    with pytest.raises(InvalidDocument):
        index.add([{"id": 9, "kind": ["a"], "text": "t"}])
    again = SearchIndex(spark, config, str(tmp_path / "index"))
    assert ids(again.search(SearchParams(query="lemon"))) == [3]
    again.delete([1, "3"])
    assert again.count() == 1 and ids(again.search(SearchParams(query="apple"))) == []
    assert {r.term for r in again.store.read("vocabulary").collect()} >= {"blue", "bicycle"} and again.store.read("vocabulary").where("term = 'apple'").count() == 0
    other = SearchIndex(spark, config.with_(stop_words=("red",)), str(tmp_path / "index"))
    assert other.needs_reindex() and other.search(SearchParams(query="blue")).total_hits == 0
    other.reindex()
    assert ids(other.search(SearchParams(query="blue"))) == [2]
    other.delete_all()
    assert other.count() == 0 and other.search(SearchParams()).total_hits == 0


def test_unchanged_documents_are_skipped(spark):
    index = SearchIndex(spark, IndexConfig())
    index.add([{"id": 1, "t": "one"}, {"id": 2, "t": "two"}])
    before = {r["id"]: r["doc_id"] for r in index.documents.collect()}
    index.add([{"id": 1, "t": "one"}, {"id": 2, "t": "deux"}])
    after = {r["id"]: r["doc_id"] for r in index.documents.collect()}
    assert after[1] == before[1] and after[2] != before[2]


def test_formatting(spark):
    index = SearchIndex(spark, IndexConfig(searchable=("text", "tags"), stop_words=("the", "of")))
    index.add([{"id": 1, "text": "Die Gassen sind groß; keeper of the lighthouse.", "tags": ["alte Gasse", "neu"]}])
    hit = index.search(SearchParams(query="grosse gasse keeper lighthouse", highlight=("text", "tags"), show_positions=True)).hits[0]
    # signs and stop words don't part what is highlighted
    assert hit["_formatted"]["text"] == "Die <em>Gassen</em> sind <em>groß; keeper of the lighthouse</em>."
    assert hit["_formatted"]["tags"] == ["alte <em>Gasse</em>", "neu"]
    assert hit["_matchesPosition"]["tags"] == {0: [{"start": 5, "length": 5}]}
    assert hit["_matchesPosition"]["text"][0] == {"start": 4, "length": 6}


def test_stems_and_compounds(spark):
    index = SearchIndex(spark, IndexConfig(searchable=("text",), languages=("de",)))
    index.add([{"id": 1, "text": "Die Gartenzwerge am Haus"}, {"id": 2, "text": "Garten und Zwerge"}, {"id": 3, "text": "Ofen"}])
    assert sorted(ids(index.search(SearchParams(query='"garten"')))) == [1, 2]
    assert sorted(ids(index.search(SearchParams(query="zwerg")))) == [1, 2]
    assert sorted(ids(index.search(SearchParams(query='"zwerg"')))) == [2]  # the stem of a word, not that of a compound's part


def test_every_hit_is_what_all_pages_have(staff, spark):
    """As rows, without a page's job and without documents in the driver: the attributes that are displayed and asked for."""
    for params in (BrowseParams(), BrowseParams(query="blaubeer", filter="age > 20", retrieve=("id", "name", "nothing")), BrowseParams(filter="gender IS NULL", retrieve=("gender",)), BrowseParams(query="ugo hanna", search_on=("team",))):
        pages, at = [], 0
        while page := staff.browse(params.with_(limit=2, offset=at)).hits:
            pages += page
            at += 2
        rows = [r.asDict() for r in staff.every_hit(params).collect()]
        assert len(rows) == len(pages) and all(rows.count(p) == pages.count(p) for p in pages)
    hidden = SearchIndex(spark, IndexConfig(searchable=("name",), displayed=("age",)))
    assert hidden.every_hit().count() == 0
    hidden.add(STAFF)
    assert sorted(hidden.every_hit().columns) == ["age", "id"]
    assert hidden.every_hit(BrowseParams(query="ugo")).collect()[0]["id"] == 2


def test_every_hit_with_distances(spark):
    index = SearchIndex(spark, IndexConfig(searchable=("name",), filterable=("place",)))
    index.add([{"id": 1, "name": "near", "place": {"lat": 10.0, "lng": 10.0}}, {"id": 2, "name": "far", "place": {"lat": 50.0, "lng": 10.0}}, {"id": 3, "name": "nowhere", "place": None}])
    params = BrowseParams(filter="_geoRadius(place, 10.1, 10, 50000)")
    assert [r["_geoDistance(place)"] for r in index.every_hit(params).collect()] == [h["_geoDistance(place)"] for h in index.browse(params).hits]
    assert index.every_hit(params.with_(retrieve=("id",))).columns == ["id"]
