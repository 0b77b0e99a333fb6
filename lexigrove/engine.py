"""An index: documents in, ranked, faceted and formatted hits out."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexigrove import schema as S
from lexigrove.config import IndexConfig
from lexigrove.errors import InvalidConfiguration, InvalidDocument, InvalidSearchParameters, PrimaryKeyNotFound
from lexigrove.functions import geo
from lexigrove.functions.language import detect, detect_attributes
from lexigrove.functions.stem import STEMMERS
from lexigrove.operators import facets, formatting, matching, paging, postings, ranking
from lexigrove.params import BrowseParams, SearchParams
from lexigrove.plans.filters import compile_filter, parse, radii
from lexigrove.plans.query import Query, matched_words, parse_query, with_stems
from lexigrove.plans.sorting import order_columns, parse_sort
from lexigrove.sources.store import Store

ENGINE_VERSION = "2"


@dataclass
class Result:
    """Hits of one page with what belongs to them. ``frame`` has the page's ids and scores, and ``matches``, which is lazy, all documents that match."""

    hits: list[dict]
    query: str
    hits_per_page: int
    page: int
    total_pages: int
    total_hits: int
    facet_distribution: dict[str, dict[str, int]] = field(default_factory=dict)
    facet_stats: dict[str, dict[str, float]] = field(default_factory=dict)
    frame: DataFrame | None = None
    matches: DataFrame | None = None

    def to_dict(self) -> dict:
        out = {"hits": self.hits, "query": self.query, "hitsPerPage": self.hits_per_page, "page": self.page, "totalPages": self.total_pages, "totalHits": self.total_hits}
        if self.facet_distribution or self.facet_stats:
            out |= {"facetDistribution": self.facet_distribution, "facetStats": self.facet_stats}
        return out


def _plain(value):
    if isinstance(value, T.Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


class SearchIndex:
    """Documents with a primary key, their postings and their vocabulary, as Parquet below a folder or, without one, in the session."""

    def __init__(self, spark: SparkSession, config: IndexConfig, path: str | None = None):
        if path is not None and not path.strip():
            raise InvalidConfiguration("The folder of an index needs a name.")
        self.spark, self.config = spark, config
        self.store = Store(spark, path)
        manifest = self.store.manifest()
        self.schema: dict[str, str] = manifest.get("schema", {})

    # documents in and out

    @property
    def documents(self) -> DataFrame | None:
        return self.store.read("documents")

    def _searchable(self) -> list[tuple[str, str]]:
        """(name, kind) of what is searched, in the order of weight."""
        docs = self.documents
        have = {f.name: S.type_of_field(f.dataType) for f in docs.schema.fields if not f.name.startswith("__") and f.name != "doc_id"} if docs is not None else {}
        names = list(have) if "*" in self.config.searchable else [a for a in self.config.searchable if a in have]
        return [(a, self.schema.get(a, have[a])) for a in names]

    def add(self, documents: list[dict] | DataFrame) -> None:
        """Adds documents, or replaces those with the same key; those that are as they were are skipped.

        Lists are checked value by value, DataFrames by their types. Of rows with one key the last of a list counts, and of a
        DataFrame the one whose contents have the greatest hash. Attributes that are new are null in older documents. An index
        that was made with other settings is rebuilt first.
        """
        if isinstance(documents, list):
            if not documents:
                return
            for d in documents:
                if d.get(self.config.primary_key) is None:
                    raise PrimaryKeyNotFound(f"A document has no {self.config.primary_key!r}.") if not self.schema else InvalidDocument(f"A document has no {self.config.primary_key!r}.")
            self.schema = S.schema_of(documents, self.config, self.schema)
            frame = self._frame(documents)
        else:
            kinds = {f.name: S.type_of_field(f.dataType) for f in documents.schema.fields}
            self.schema = S.merge(self.schema, kinds, self.config)
            frame = documents
            if not frame.where(F.col(f"`{self.config.primary_key}`").isNull()).isEmpty():
                raise InvalidDocument(f"A document has no {self.config.primary_key!r}.")
            for f in documents.schema.fields:
                if S.type_of_field(f.dataType) == S.NUMBER and f.name != self.config.primary_key:
                    frame = frame.withColumn(f.name, F.col(f"`{f.name}`").cast("double"))
        self._upsert(frame)

    def _frame(self, documents: list[dict]) -> DataFrame:
        """A typed DataFrame of Python documents."""
        key, names = self.config.primary_key, list(dict.fromkeys(k for d in documents for k in d))
        last = {str(d[key]): d for d in documents}
        kinds: dict[str, str] = {}
        for d in last.values():
            for n, v in d.items():
                kind = S.type_of_value(v)
                kinds[n] = kind if n not in kinds else S.narrower(kinds[n], kind) if S.compatible(kinds[n], kind) else S.STRING
        kinds |= {n: k for n, k in self.schema.items() if n in kinds}
        fields = []
        for n in names:
            whole = n == key and all(isinstance(d[n], int) for d in last.values())
            fields.append(T.StructField(n, T.LongType() if whole else S.spark_type(kinds[n])))

        def cast(value, kind: str, whole: bool):
            if value is None:
                return None
            if kind == S.NUMBER:
                return int(value) if whole else float(value)
            if kind == S.GEO:
                return (float(value["lat"]), float(value["lng"]))
            if kind == S.NUMBERS:
                return [float(v) for v in value]
            if kind in S.MULTI:
                return [v if isinstance(v, str) else S.flat_text(v) for v in (value.values() if isinstance(value, dict) else value)]
            return value if kind == S.BOOLEAN else value if isinstance(value, str) else json.dumps(value)

        rows = [tuple(cast(d.get(f.name), kinds[f.name], isinstance(f.dataType, T.LongType)) for f in fields) for d in last.values()]
        return self.spark.createDataFrame(rows, T.StructType(fields))

    def _displayed(self, frame: DataFrame) -> DataFrame:
        if "*" in self.config.displayed:
            return frame
        wanted = {*self.config.displayed, *self.config.schema_attributes}
        return frame.select(*(f"`{c}`" for c in frame.columns if c in wanted))

    def _upsert(self, frame: DataFrame) -> None:
        key = self.config.primary_key
        frame = self._displayed(frame)
        content = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(frame.columns)))))
        new = frame.withColumns({"__key": F.col(f"`{key}`").cast("string"), "__hash": content, "__order": F.monotonically_increasing_id()})
        new = new.groupBy("__key").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in new.columns)), "__hash").alias("row")).select("row.*")
        with self.store.writing():
            if self.needs_reindex():
                self.reindex()
            manifest = self.store.manifest()
            old = self.documents
            if old is None:
                new = new.withColumn("__replaced", F.lit(None).cast("bigint"))
            else:
                known = old.select("__key", F.col("__hash").alias("__old"), F.col("doc_id").alias("__replaced"))
                new = new.join(known, "__key", "left").where("__old is null or __old <> __hash").drop("__old")
            documents = self.store.write(new.withColumn("doc_id", F.lit(manifest.get("next", 0)) + F.col("__order")).drop("__order"))
            written = self.store.open([documents])  # ids are fixed from here on
            last, replaced = written.agg(F.max("doc_id"), F.count("__replaced")).first()
            if last is None and manifest:
                self.store._delete(documents["name"])
                return
            segment = self.store.segment(documents, self._postings(written), postings.vocabulary)
            gone = [self.store.write(written.where("__replaced is not null").select(F.col("__replaced").alias("doc_id"))) | {"rows": replaced}] if replaced else []
            self._commit([*manifest.get("segments", []), segment], [*manifest.get("gone", []), *gone], (last + 1) if last is not None else 0, segment)

    def _postings(self, docs: DataFrame) -> DataFrame:
        have = {f.name: S.type_of_field(f.dataType) for f in docs.schema.fields if not f.name.startswith("__") and f.name != "doc_id"}
        names = list(have) if "*" in self.config.searchable else list(self.config.searchable)
        attributes = [(a, have.get(a, S.NULL)) for a in names]
        for name, _ in attributes:
            if name not in have:
                docs = docs.withColumn(name, F.lit(None).cast("string"))
        base = postings.postings(docs, attributes)
        if not self.config.typo.enabled:
            return base.withColumn("variant", F.lit(False))
        languages = None
        if len(self.config.languages) == 1:
            languages = self.config.languages[0]
        elif attributes:
            each = detect_attributes([F.coalesce(postings.text_of(n, k), F.lit("")) for n, k in attributes], self.config.languages)
            languages = docs.select("doc_id", F.posexplode(each).alias("attribute", "language")).where("language is not null")
        split = any(lang in ("de", "en") for lang in self.config.languages)
        return postings.with_variants(base, languages, split)

    def _commit(self, segments: list[dict], gone: list[dict], following: int, like: dict | None = None, everything: bool = False) -> None:
        before = self.store.manifest()
        empty = {t: like[t]["schema"] for t in ("documents", "postings", "vocabulary")} if like else before.get("empty")
        manifest = {"engine": ENGINE_VERSION, "config": self.config.hash(), "schema": self.schema, "uid": before.get("uid") or uuid.uuid4().hex, "empty": empty, "next": following, "segments": segments, "gone": gone}
        self.store.commit(self.store.merged(manifest, postings.vocabulary, everything))

    def delete(self, keys: list) -> None:
        """Deletes the documents with these keys; what only they had is gone from postings and vocabulary too. The keys come from the caller; a list of ids is written, no documents."""
        with self.store.writing():
            old = self.documents
            if old is None or not keys:
                return
            wanted = self.spark.createDataFrame([(str(k),) for k in set(keys)], "__key string")
            self._delete(old.join(F.broadcast(wanted) if len(keys) <= 100_000 else wanted, "__key", "left_semi").select("doc_id"))

    def delete_where(self, condition: str) -> None:
        """Deletes the documents that a filter matches."""
        with self.store.writing():
            if self.documents is not None:
                tree = parse(condition, self.config.filterable)
                self._delete(self.documents.where(compile_filter(tree, self.schema, self.config.primary_key)).select("doc_id"))

    def _delete(self, ids: DataFrame) -> None:
        manifest, gone = self.store.manifest(), self.store.write(ids)
        rows = self.store.open([gone]).count()
        if rows:
            self._commit(manifest["segments"], [*manifest["gone"], gone | {"rows": rows}], manifest["next"])
        else:
            self.store._delete(gone["name"])

    def delete_all(self) -> None:
        with self.store.writing():
            if self.documents is not None:
                self._commit([], [], self.store.manifest()["next"])

    def compact(self) -> None:
        """Rewrites the index as one segment without replaced documents, of files as large as the session's settings make them."""
        with self.store.writing():
            m = self.store.manifest()
            if m:
                self._commit(m["segments"], m["gone"], m["next"], everything=True)

    def statistics(self) -> dict:
        """Documents, replaced documents that are still there, segments and bytes."""
        m = self.store.manifest()
        return {"documents": self.count(), "replaced": sum(g["rows"] for g in m.get("gone", ())), "segments": len(m.get("segments", ())), "bytes": self.size()}

    def get(self, key) -> dict | None:
        docs = self.documents
        if docs is None:
            return None
        row = docs.where(F.col("__key") == str(key)).limit(1).collect()
        return self._document(row[0]) if row else None

    def count(self) -> int:
        return 0 if self.documents is None else self.documents.count()

    def size(self) -> int:
        """Bytes of the index's files."""
        return self.store.size()

    def needs_reindex(self) -> bool:
        """Whether documents were indexed by another engine or with other settings."""
        m = self.store.manifest()
        return bool(m) and (m.get("engine"), m.get("config")) != (ENGINE_VERSION, self.config.hash())

    def reindex(self) -> None:
        """Rebuilds everything from the stored documents."""
        with self.store.writing():
            m, docs = self.store.manifest(), self.documents
            if docs is not None:
                documents = self.store.write(docs)
                segment = self.store.segment(documents, self._postings(self.store.open([documents])), postings.vocabulary)
                self._commit([segment] if segment["count"] else [], [], m["next"], segment)

    def _document(self, row: T.Row, only: tuple[str, ...] = ("*",)) -> dict:
        d = row.asDict()
        out = {k: _plain(v) for k, v in d.items() if not k.startswith("__") and k != "doc_id" and ("*" in only or k in only)}
        if "*" not in self.config.displayed:
            out = {k: v for k, v in out.items() if k in (*self.config.displayed, self.config.primary_key)}
        return {k: v for k, v in out.items() if v is not None or k in self.schema}

    # queries

    def browse(self, params: BrowseParams | None = None) -> Result:
        """Matching documents in the order of ingestion: no ranking, no facets, no cap on the total."""
        return self._run(params or BrowseParams())

    def every_hit(self, params: BrowseParams | None = None) -> DataFrame:
        """What browse gives on all its pages together, as rows in no order: nothing of them goes to the driver. Attributes that a document lacks are null; limit and page don't count."""
        params = params or BrowseParams()
        query, tree, docs = self._query(params.query), parse(params.filter, self.config.filterable), self.documents
        if docs is None:
            return self.spark.createDataFrame([], f"`{self.config.primary_key}` string")
        shown = self._shown(docs.columns, params)
        if self.needs_reindex():
            return docs.where("false").select(*(F.col(f"`{c}`") for c in shown))
        rows = self.matching(params, query, False)
        for r in radii(tree):
            name = f"_geoDistance({r.attribute})"
            before, rows = rows.columns, self._with_distance(rows, r.attribute, r.lat, r.lng)
            if rows.columns != before and ("*" in params.retrieve or name in params.retrieve):
                shown.append(name)
        return rows.select(*(F.col(f"__distance_{c[13:-1]}").alias(c) if c.startswith("_geoDistance(") else F.col(f"`{c}`") for c in shown))

    def _shown(self, columns: list[str], params: BrowseParams) -> list[str]:
        """The documents' columns that are displayed and asked for."""
        displayed = [c for c in columns if not c.startswith("__") and c != "doc_id" and ("*" in self.config.displayed or c in (*self.config.displayed, self.config.primary_key))]
        return [c for c in displayed if "*" in params.retrieve or c in params.retrieve]

    def search(self, params: SearchParams | None = None) -> Result:
        return self._run(params or SearchParams())

    def matching(self, params: BrowseParams, query: Query, count_typos: bool = True) -> DataFrame:
        """All documents that pass the filter and match the query, with the columns ranking needs."""
        docs = self.documents
        tree = parse(params.filter, self.config.filterable)
        kept = docs.where(compile_filter(tree, self.schema, self.config.primary_key))
        if not query.tokens:
            return kept
        places = None
        if "*" not in params.search_on:
            places = [i for i, (a, _) in enumerate(self._searchable()) if a in params.search_on]
        how = params.matching_strategy if isinstance(params, SearchParams) else "any"
        m = self.store.manifest()
        if not m["segments"]:
            return matching.matching_documents(kept, self.store.read("postings"), self.store.read("terms"), query, self.config, how, places)
        return matching.matching_documents(kept, self.store.postings_of(m), self.store.read("terms"), query, self.config, how, places, count_typos)

    def _query(self, text: str) -> Query:
        """The parsed query; its words outside of phrases also stand for their stems in its language: the index's only one, else the one that is detected."""
        query = parse_query(text, self.config)
        if not self.config.typo.enabled or not query.tokens:
            return query
        language = self.config.languages[0] if len(self.config.languages) == 1 else detect(query.text, self.config.languages, reliable=False)
        return with_stems(query, language)

    def _run(self, params: BrowseParams) -> Result:
        searching = isinstance(params, SearchParams)
        query = self._query(params.query)
        tree = parse(params.filter, self.config.filterable)
        keys = parse_sort(params.sort, self.config) if searching else []
        limit, offset = params.window()
        cap = self.config.max_total_hits
        if searching:
            limit = min(limit, cap)
            offset = min(offset, max(cap - limit, 0))
        if self.documents is None or self.needs_reindex():
            return Result([], query.analysed, limit, 1, 0, 0)
        ranked = searching and bool(query.tokens) and any(k.kind == "relevance" for k in keys)
        matches = self.matching(params, query, ranked and "typo" in self.config.ranking_rules)
        score = F.round(ranking.score(query, self.config), 12) if ranked else F.lit(0.0)
        wanted = {}
        if searching:
            wanted = {a: self.schema[a] for a in params.facets if a in self.config.filterable and a in self.schema}
            if any(kind == S.GEO for kind in wanted.values()):
                raise InvalidSearchParameters("A location cannot be a facet.")
            if params.distinct is not None and (params.distinct not in self.config.filterable or self.schema.get(params.distinct, S.STRING) in (*S.MULTI, S.GEO)):
                raise InvalidSearchParameters(f"{params.distinct!r} must be a filterable attribute with single values.")
        # what order, distances, distinct and facets need of the documents; the rest is read for the page alone
        narrow = [c for c in dict.fromkeys(["doc_id", *self.config.filterable, *self.config.sortable, self.config.primary_key]) if c in self.documents.columns]
        found = matches.select(*(F.col(f"`{c}`") for c in narrow), score.alias("__score")).persist()
        try:
            rows = found.where(F.col("__score") >= params.score_threshold) if ranked and params.score_threshold > 0 else found
            order = order_columns(keys, self.schema, self.config, tree, F.col("__score") if ranked else None)
            if searching and params.distinct in self.schema:
                rows = paging.distinct_best(rows, params.distinct, order)
            for r in radii(tree):
                rows = self._with_distance(rows, r.attribute, r.lat, r.lng)
            for k in keys:
                if k.kind == "geo":
                    rows = self._with_distance(rows, k.attribute, *k.point)
            total = rows.count()
            total = min(total, cap) if searching else total
            page = paging.page(rows, order, limit, offset).select("doc_id", "__score", *(c for c in rows.columns if c.startswith("__distance_"))).collect() if total else []
            whole = {r["doc_id"]: r for r in self.documents.where(F.col("doc_id").isin([r["doc_id"] for r in page])).collect()} if page else {}
            hits = [self._hit(whole[r["doc_id"]], r.asDict(), params, query) for r in page]
            number, pages = paging.page_numbers(total, limit, offset)
            out = Result(hits, query.analysed, limit, number, pages, total, frame=self.spark.createDataFrame([(r["doc_id"], r["__score"]) for r in page], "doc_id bigint, score double"), matches=matches)
            if wanted:
                for r in facets.distribution(found, wanted, params.max_values_per_facet).collect():
                    out.facet_distribution.setdefault(r["attribute"], {})[r["value"]] = r["count"]
                out.facet_distribution |= {a: out.facet_distribution.get(a, {}) for a in wanted}
                out.facet_stats = {r["attribute"]: {"min": r["min"], "max": r["max"]} for r in facets.stats(found, wanted).collect()}
            return out
        finally:
            found.unpersist()

    def _with_distance(self, rows: DataFrame, attribute: str, lat: float, lng: float) -> DataFrame:
        name = f"__distance_{attribute}"
        if name in rows.columns or self.schema.get(attribute) != S.GEO:
            return rows
        return rows.withColumn(name, F.round(geo.distance(F.col(f"`{attribute}`.lat"), F.col(f"`{attribute}`.lng"), lat, lng)).cast("bigint"))

    def _hit(self, row: T.Row, found: dict, params: BrowseParams, query: Query) -> dict:
        whole = self._document(row)
        hit = {k: v for k, v in whole.items() if "*" in params.retrieve or k in params.retrieve}
        for k, v in found.items():
            if k.startswith("__distance_") and v is not None and ("*" in params.retrieve or f"_geoDistance({k[11:]})" in params.retrieve):
                hit[f"_geoDistance({k[11:]})"] = v
        if not isinstance(params, SearchParams):
            return hit
        if params.show_score:
            hit["_rankingScore"] = round(found["__score"] or 0.0, 5)
        if params.highlight or params.crop or params.show_positions:
            self._format(hit, whole, params, query)
        return hit

    def _format(self, hit: dict, whole: dict, params: SearchParams, query: Query) -> None:
        searchable = [a for a, _ in self._searchable() if "*" in params.search_on or a in params.search_on]
        language = self.config.languages[0] if len(self.config.languages) == 1 and self.config.languages[0] in STEMMERS else None
        shown = {k: v for k, v in hit.items() if not k.startswith("_")}
        emphasised = whole.keys() if "*" in params.highlight else params.highlight
        cropped = {a: params.crop.get(a, params.crop.get("*", params.crop_length)) for a in whole if a in params.crop or "*" in params.crop}
        positions: dict = {}
        for name, value in whole.items():
            if name in emphasised or name in cropped:
                shown.setdefault(name, value)

            def show(text, name=name):
                found = matched_words(text, query, self.config, language) if isinstance(text, str) and name in searchable else []
                spans = formatting.merged_spans(text, found, self.config.stop_words) if found else []
                tags = (params.highlight_start, params.highlight_end) if name in emphasised else ("", "")
                if not isinstance(text, str):
                    return text, found
                if name in cropped:
                    return formatting.crop(text, spans, cropped[name], params.crop_marker, params.crop_fragments, params.prioritize_matches, *tags), found
                return formatting.highlight(text, spans, *tags), found

            if isinstance(value, list):
                each = [show(v) for v in value]
                if name in shown and (name in emphasised or name in cropped):
                    shown[name] = [e[0] for e in each]
                spots = {i: [{"start": w.start, "length": w.end - w.start} for w in e[1]] for i, e in enumerate(each) if e[1]}
            else:
                text, found = show(value)
                if name in shown and (name in emphasised or name in cropped):
                    shown[name] = text
                spots = [{"start": w.start, "length": w.end - w.start} for w in found]
            if spots and name in searchable:
                positions[name] = spots
        if params.highlight or params.crop:
            hit["_formatted"] = shown
        if params.show_positions:
            hit["_matchesPosition"] = positions
