"""A stored inverted index of documents, updated by document; queries read the postings asked for.

Tables under one path, a folder a generation, written whole before the generation's row of `totals`, which
makes it count; a failed update leaves a folder that the next one of its number overwrites:

- pages: doc_id, page, text, length, words; by buckets of doc_id
- postings: token, doc_id, page, tf, length; by buckets of the token, sorted by it
- frequency: token and by how many pages this generation changes its count; by buckets of the token
- near: key -> token, where key is the token, or its folded form, less a letter, or a prefix of it; by buckets of the key
- dead: doc_id of documents whose older generations no longer count
- totals: by how much this generation changes the pages and their length

An update reads the old pages of its own documents only, and takes their counts back. A search expands its
terms through `near`, reads frequencies and postings of the tokens found, from their buckets alone (and, up
to LITERALS tokens, by a pushed list of them), and scores. Nothing scans the texts.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import finding

from .shared import hadoop, shared_dir

SCHEMAS = {
    "pages": "doc_id long, page int, text string, words array<string>, length double, generation int, bucket int",
    "postings": "doc_id long, page int, length double, token string, tf long, generation int, bucket int",
    "frequency": "token string, containing long, generation int, bucket int",
    "near": "token string, key string, form int, generation int, bucket int",
    "dead": "doc_id long, generation int",
    "totals": "pages long, length double, generation int",
}
#: Up to so many tokens or keys a search pushes their list into the scan.
LITERALS = 500


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


class SearchIndex:
    """The index at `path`; `buckets` is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.generation = self._newest()

    # ---- tables

    def _newest(self) -> int:
        fs, p = hadoop(self.spark, f"{self.path}/totals")
        if not fs.exists(p):
            return -1
        done = [f.getPath() for f in fs.listStatus(p)]
        made = [int(x.getName().split("=")[1]) for x in done if x.getName().startswith("generation=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return max(made, default=-1)

    def _write(self, df: DataFrame, name: str, generation: int, by: str | None = None) -> None:
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{self.path}/{name}/generation={generation}")

    def table(self, name: str, only: int | None = None) -> DataFrame:
        """A table's rows of the generations that count, or of one."""
        which = range(self.generation + 1) if only is None else [only]
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/generation={g}" for g in which))

    def _live(self, df: DataFrame) -> DataFrame:
        """Rows (doc_id, generation) that no later generation has replaced."""
        if self.generation == 0:
            return df
        dead = self.table("dead").groupBy(F.col("doc_id").alias("_dead")).agg(F.max("generation").alias("_since"))
        return df.join(dead, (F.col("doc_id") == F.col("_dead")) & (F.col("generation") < F.col("_since")), "left_anti")

    def _few(self, df: DataFrame, column: str) -> Column:
        """A filter for the rows of df's keys: their buckets, and the keys themselves if they are few. At most LITERALS + 1 keys, or one row of buckets, reach the driver."""
        found = [r[0] for r in df.select(column).distinct().limit(LITERALS + 1).collect()]
        if len(found) <= LITERALS:
            buckets = [r[0] for r in self.spark.createDataFrame([(x,) for x in found], "k string").select(_bucket(F.col("k"), self.buckets)).distinct().collect()]
            return F.col("bucket").isin(buckets) & F.col(column).isin(found)
        buckets = df.agg(F.collect_set(_bucket(F.col(column), self.buckets))).first()[0]
        return F.col("bucket").isin(buckets)

    # ---- writing

    def update(self, docs: DataFrame) -> SearchIndex:
        """docs (doc_id, text) are new, or take the place of those of their id; one without text goes. Ids come once and aren't null."""
        g = self.generation + 1
        docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        slot = _bucket(F.col("doc_id"), self.buckets).alias("bucket")
        pages = finding.pages_of(docs)
        self._write(pages.select("*", slot).repartition(self.buckets, "bucket"), "pages", g, "bucket")
        new = self.table("pages", g)
        counted = new.select("doc_id", "page", "length", F.explode("words").alias("token")).groupBy("doc_id", "page", "length", "token").agg(F.count("*").alias("tf"))
        slotted = counted.withColumn("bucket", _bucket(F.col("token"), self.buckets))
        self._write(slotted.repartitionByRange("bucket", "token").sortWithinPartitions("bucket", "token"), "postings", g, "bucket")
        each = new.select(F.lit(1).alias("n"), "length", "words")
        if g:
            dead = docs.select("doc_id").distinct()
            self._write(dead, "dead", g)
            old = self._live(self.table("pages")).join(dead, "doc_id", "left_semi")
            each = each.union(old.select(F.lit(-1), "length", "words"))
        else:
            self._write(self.spark.createDataFrame([], docs.select("doc_id").schema), "dead", g)
        frequency = each.select("n", F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.sum("n").alias("containing")).where("containing <> 0")
        self._write(frequency.withColumn("bucket", _bucket(F.col("token"), self.buckets)).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "token"), "frequency", g, "bucket")
        tokens = self.table("frequency", g).where("containing > 0").select("token")
        if g:
            tokens = tokens.join(self.table("frequency").select("token"), "token", "left_anti")
        self._write(self._keys(tokens).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key"), "near", g, "bucket")
        self._write(each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0.0)).alias("length")).coalesce(1), "totals", g)
        self.generation = g
        return self

    def _keys(self, tokens: DataFrame) -> DataFrame:
        """token -> bucket, key, form (0 as it is, 1 folded, 2 prefix), token."""
        raw = F.transform(F.array_distinct(finding.one_less(F.col("token"))), lambda k: F.struct(k.alias("key"), F.lit(0).alias("form")))
        folded = F.transform(F.array_distinct(finding.one_less(finding.ocr_fold(F.col("token")))), lambda k: F.struct(k.alias("key"), F.lit(1).alias("form")))
        last = F.length("token") - 1
        starts = F.when(last >= finding.FUZZY_FROM, F.transform(F.sequence(F.lit(finding.FUZZY_FROM), last), lambda n: F.struct(F.substring("token", F.lit(1), n).alias("key"), F.lit(2).alias("form"))))
        keys = tokens.select("token", F.explode(F.concat(raw, folded, F.coalesce(starts, F.slice(raw, 1, 0)))).alias("k"))
        return keys.select("token", "k.key", "k.form").withColumn("bucket", _bucket(F.col("key"), self.buckets))

    # ---- reading

    def expand(self, terms: DataFrame) -> DataFrame:
        """terms (term) -> term, token, weight, containing, as finding.fuzzy_expand has them; reads the buckets of their keys."""
        terms = terms.select("term").distinct()
        long = terms.where(F.length("term") >= finding.FUZZY_FROM)
        form = lambda f, x: F.transform(F.array_distinct(finding.one_less(x)), lambda k: F.struct(k.alias("key"), F.lit(f).alias("form"), x.alias("as")))
        whole = F.array(F.struct(F.col("term").alias("key"), F.lit(2).alias("form"), F.col("term").alias("as")))
        asked = long.select("term", F.explode(F.concat(form(0, F.col("term")), form(1, finding.ocr_fold(F.col("term"))), whole)).alias("k")).select("term", "k.*")
        near = self.table("near").where(self._few(asked, "key")).join(asked, ["key", "form"])
        seen = F.when(F.col("form") == 1, finding.ocr_fold(F.col("token"))).otherwise(F.col("token"))
        near = near.where((F.col("form") == 2) | (F.levenshtein("as", seen, 1) >= 0)).where("term <> token").select("term", "token").distinct()
        both = terms.select("term", F.col("term").alias("token"), F.lit(1.0).alias("weight")).union(near.select("term", "token", F.lit(finding.FUZZY).alias("weight")))
        return both.join(self.frequency(both), "token").select("term", "token", "weight", "containing")

    def frequency(self, tokens: DataFrame) -> DataFrame:
        """token -> containing, for tokens that some page holds."""
        tokens = tokens.select("token").distinct()
        found = self.table("frequency").where(self._few(tokens, "token")).join(tokens, "token", "left_semi")
        return found.groupBy("token").agg(F.sum("containing").alias("containing")).where("containing > 0")

    def totals(self) -> tuple[int, float]:
        """Pages and their average length."""
        r = self.table("totals").agg(F.sum("pages").alias("n"), F.sum("length").alias("length")).first()
        return r.n or 0, (r.length / r.n if r.n else 0.0)

    def postings(self, tokens: DataFrame) -> DataFrame:
        """doc_id, page, length, token, tf of the tokens' live postings."""
        tokens = tokens.select("token").distinct()
        found = self.table("postings").where(self._few(tokens, "token")).join(tokens, "token", "left_semi")
        return self._live(found).select("doc_id", "page", "length", "token", "tf")

    def scores(self, queries: DataFrame) -> DataFrame:
        """queries (query, text) -> what finding.page_scores gives for the documents as they are now."""
        terms = queries.select("query", F.explode(F.array_distinct(finding.tokenise(F.col("text")))).alias("term"))
        asked = self.expand(terms)
        pages, average = self.totals()
        return finding.scored(self.postings(asked), terms.join(asked, "term"), F.lit(float(pages)), F.lit(average))

    def search(self, queries: DataFrame, most: int = finding.MOST, least: float = finding.LEAST) -> DataFrame:
        """query, doc_id, page, score, exact_terms, fuzzy, place, and the snippet around the first token found."""
        best = finding.search_rank(finding.best_page_per_document(self.scores(queries), least), most)
        wanted = best.select("doc_id", "page").distinct()
        texts = self._live(self.table("pages")).join(wanted, ["doc_id", "page"], "left_semi").select("doc_id", "page", "text")
        terms = queries.select("query", finding.tokenise(F.col("text")).alias("_terms"))
        return best.join(texts, ["doc_id", "page"]).join(terms, "query").withColumn("snippet", finding.snippet(F.col("text"), F.col("_terms"))).drop("text", "_terms")

    def refusals(self, queries: DataFrame, least: float = finding.LEAST) -> DataFrame:
        """query, reason for those without a result: nothing was observed, no searchable term, or no document with the terms."""
        pages, _ = self.totals()
        asked = queries.select("query", (F.size(finding.tokenise(F.col("text"))) > 0).alias("_some"))
        found = self.scores(queries).where(F.col("score") >= least).select("query").distinct()
        reason = F.when(F.lit(pages == 0), "no documents").when(~F.col("_some"), "no searchable terms").otherwise("no document with these terms")
        return asked.join(found, "query", "left_anti").select("query", reason.alias("reason"))


_kept: dict[tuple, SearchIndex] = {}


def index_of(spark: SparkSession, source: str) -> SearchIndex:
    """The index of a table of documents in the shared folder, built once and as long as the source's files stay the same."""
    fs, p = hadoop(spark, source)
    files = fs.listStatus(p)
    stamp = (spark.sparkContext.applicationId, source, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    if stamp not in _kept:
        for old in [k for k in _kept if k[:2] == stamp[:2]]:
            where, gone = hadoop(spark, _kept.pop(old).path)
            where.delete(gone, True)
        path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
        _kept[stamp] = SearchIndex(spark, path).update(spark.read.parquet(source).select("doc_id", "text"))
    return _kept[stamp]
