"""The term pipeline's commands: each reads the tables of the stages before it and writes its own under the corpus folder."""

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions import vectors as V
from termloom.operators import clusters as C
from termloom.operators import corpus, lexicon, lsa, patterns, phrases, tagging
from termloom.operators import vectors as O
from termloom.session import session
from termloom.sources import files


@dataclass(frozen=True)
class Options:
    corpus_dir: str
    patterns_file: str | None = None
    stop_words_file: str | None = None
    emb_model_file: str | None = None
    lexicon_file: str | None = None
    senses_file: str | None = None
    links_file: str | None = None
    limit: int | None = None
    clean_stop_words: bool = True
    validate_boundaries: bool = True
    max_run: int | None = None

    def __post_init__(self):
        if self.limit is not None and self.limit < 1:
            raise ValueError(f"limit is out of range: {self.limit}")


class Pipeline:
    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.o = spark, options

    def path(self, name: str) -> str:
        return f"{self.o.corpus_dir.rstrip('/')}/{name}"

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def store(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))

    def needed(self, option: str) -> str:
        if not (value := getattr(self.o, option)):
            raise ValueError(f"this command needs --{option.replace('_', '-')}")
        return value

    def docs(self) -> DataFrame:
        """doc_id and text of the articles; a title names a document, so articles of one title are one."""
        a = files.articles(self.spark, self.path("texts"))
        return a.groupBy(F.coalesce("title", F.col("doc_id").cast("string")).alias("title")).agg(F.min("doc_id").alias("doc_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text")).select("doc_id", "text")

    def tokens(self) -> DataFrame:
        t = corpus.sentence_tokens(self.docs())
        return tagging.tag_by_lexicon(t, self.spark.read.parquet(self.o.lexicon_file)) if self.o.lexicon_file else tagging.tag(t)

    def build_tokenized_corpus(self) -> None:
        """sentences: doc_id, sent_no, sentence and its lemmas joined by spaces."""
        words = self.tokens().groupBy("doc_id", "sent_no").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("ws"))
        s = corpus.sentences(self.docs()).join(words, ["doc_id", "sent_no"], "left")
        self.store(s.select("doc_id", "sent_no", "sentence", F.array_join(F.transform(F.coalesce("ws", F.array().cast("array<struct<pos:int,lemma:string>>")), lambda x: x["lemma"]), " ").alias("normalized")), "sentences")

    def collect_phrases(self) -> None:
        """occurrences of the patterns, and word_stats and totals of the lemmas."""
        text = self.spark.read.text(self.needed("patterns_file"), wholetext=True).first()[0]
        stop = files.words(self.spark, self.needed("stop_words_file")) if self.o.clean_stop_words else None
        tokens = self.tokens()
        self.store(patterns.collect_phrases(tokens, patterns.parse(text), stop, self.o.validate_boundaries, self.o.max_run), "occurrences")
        self.spark.catalog.clearCache()
        by_doc = tokens.groupBy(F.col("lemma").alias("w"), "doc_id").agg(F.count("*").alias("n"))
        self.store(by_doc.groupBy("w").agg(F.sum("n").alias("wf"), F.count("*").alias("df")), "word_stats")
        self.store(corpus.totals(self.docs()), "totals")

    def filter_corpus(self) -> None:
        """filtered_texts and filtered_stats; the totals stay."""
        self.store(corpus.filter_texts(self.docs()), "filtered_texts")
        self.store(corpus.filter_stats(self.stored("word_stats")), "filtered_stats")

    def tfidf(self) -> DataFrame:
        t = F.broadcast(self.stored("totals"))  # one row
        return self.stored("filtered_stats").crossJoin(t).select("w", (F.col("wf") / F.col("total_words") * F.log(F.col("total_docs") / (1 + F.col("df")))).alias("tfidf"))

    def compute_text_metrics(self) -> None:
        """clusters of similar keys with frequency and, given word vectors and topics.txt, tag_match."""
        occ = self.stored("occurrences").where(~F.col("key").rlike(r"[_\p{Nd}]"))
        n = self.o.limit
        docs = self.spark.range(n).select(F.col("id").alias("doc_id")) if n else self.docs()
        c = C.clusters(occ, docs)
        heads = phrases.merge_similar(c.select("key", "cnt")).select(F.col("head").alias("key"), F.col("cnt").alias("merged"))
        out = c.join(heads, "key").withColumn("frequency", F.round(F.col("frequency") * F.col("merged") / F.col("cnt"), 8)).withColumn("cnt", F.col("merged")).drop("merged")
        if self.o.emb_model_file:
            words = self.spark.read.parquet(self.o.emb_model_file)  # w, v
            topics = files.topics(self.spark, self.path("topics.txt"))
            v = O.phrase_vectors(out.select(F.col("key").alias("phrase")), words).withColumnRenamed("phrase", "id")
            t = O.phrase_vectors(topics.withColumnRenamed("topic", "phrase"), words).select(F.col("phrase").alias("topic"), F.col("v").alias("c"))
            counts = O.topic_counts(O.matches(v, t, 0.6), out.select(F.col("key").alias("id")), 0.12, 7)
            out = out.join(counts.select(F.col("id").alias("key"), "tag_match"), "key", "left")
        else:
            out = out.withColumn("tag_match", F.lit(False))
        self.store(out, "clusters")

    def load_hypernyms(self) -> None:
        """lemma_relations of the clusters' words, from tables of senses and links."""
        words = self.stored("clusters").select(F.explode(F.split("key", " ")).alias("lemma")).distinct()
        read = self.spark.read.parquet
        self.store(lexicon.related_words(words, read(self.needed("senses_file")), read(self.needed("links_file"))), "lemma_relations")

    def perform_lsa(self) -> None:
        """word_directions, topic_words, and lsa: topic_relevance and centrality of each cluster from its words' directions."""
        u, _ = lsa.svd(lsa.term_doc(self.stored("sentences").select("doc_id", F.col("normalized").alias("text"))), 100)
        self.store(u, "word_directions")
        u = self.stored("word_directions")
        self.store(lsa.topics(u, 5, 30), "topic_words")
        own = self.stored("clusters").select("key", F.explode(F.split("key", " ")).alias("w")).join(u.withColumnRenamed("u", "v"), "w")
        center = O.centroids(own, "key")
        near = own.join(center, "key").groupBy("key").agg(F.round(F.avg(V.cosine(F.col("v"), F.col("c"))), 6).alias("centrality"))
        self.store(O.topic_relevance(own, "key").withColumnRenamed("relevance", "topic_relevance").join(near, "key"), "lsa")

    def get_terminological_phrases(self) -> None:
        """terms: the selected clusters with their contexts, and their list as text."""
        c = self.stored("clusters").join(self.stored("lsa"), "key", "left").na.fill(0.0, ["topic_relevance", "centrality"])
        weak = C.select_terms(c, self.tfidf()).select("key")
        kept = c.join(weak.unionByName(c.where((F.col("topic_relevance") > 0.4) & ~T.roman(F.col("key"))).select("key")).distinct(), "key", "left_semi")
        s = self.stored("sentences")
        texts = self.stored("occurrences").join(s, ["doc_id", "sent_no"]).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("sentence")), " | ").alias("context"))
        self.store(kept.join(texts, "key", "left"), "terms")
        self.stored("terms").select("key").orderBy("key").write.mode("overwrite").text(self.path("terms_list"))


COMMANDS = ("build_tokenized_corpus", "collect_phrases", "filter_corpus", "compute_text_metrics", "load_hypernyms", "perform_lsa", "get_terminological_phrases")


def parser() -> argparse.ArgumentParser:
    flag: Callable[[str], bool] = lambda x: {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[x.lower()]
    p = argparse.ArgumentParser("termloom", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--corpus-dir", required=True, help="folder of texts/ and of the stages' tables")
    for name, what in (("patterns-file", "grammar patterns"), ("stop-words-file", "stop words, one a line"), ("emb-model-file", "word vectors, a table of w and v"), ("lexicon-file", "readings of word forms, a table"), ("senses-file", "wordnet senses, a table"), ("links-file", "wordnet links, a table")):
        p.add_argument(f"--{name}", help=what)
    p.add_argument("--limit", type=int, help="number of texts that frequencies refer to (all, by default)")
    p.add_argument("--max-run", type=int, help="longest repetition inside a phrase (any, by default)")
    for name in ("clean-stop-words", "validate-boundaries"):
        p.add_argument(f"--{name}", type=flag, default=True)
    return p


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    getattr(Pipeline(session(), Options(**args)), command)()
