"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the given fixture tables (or data Spark derives from them)
over whole tables; parameters are the reference's defaults unless noted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions import text as TX
from lexis.operators import retrieve as R
from lexis.operators.store import DOC_KEYS, build_store, line_documents, line_pairs, process_lines
from lexis.session import delete_path, once, read_table, scratch_path, shuffles_freed

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# ---------------------------------------------------------------------------
# Retrieval (R1-R6): benchmark passages as questions, documents lines as store
# ---------------------------------------------------------------------------

def _questions(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                 F.col("text").alias("query"))


def _store(spark, sf_dir) -> DataFrame:
    return build_store(_t(spark, sf_dir, "documents"))


def _sample(spark, sf_dir) -> DataFrame:
    """The n sampled lines with their content: drawn before tokenising, kept once."""
    lines = line_documents(_t(spark, sf_dir, "documents")).filter(TX.non_blank("line"))
    return once(process_lines(R.candidate_sample(lines, DOC_KEYS)), "sample")


@register("candidate_sample")
def q_candidate_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select(*DOC_KEYS, "content")


@register("score_candidates")
def q_score_candidates(spark, sf_dir):
    scored = R.score_candidates(_questions(spark, sf_dir), _sample(spark, sf_dir), DOC_KEYS)
    return scored.withColumn("similarity", F.round("similarity", 6))


@register("rank_content")
def q_rank_content(spark, sf_dir):
    ranked = R.rank_content(_questions(spark, sf_dir), _store(spark, sf_dir), DOC_KEYS)
    return ranked.select("query_id", "rank", *DOC_KEYS, F.round("similarity", 6).alias("similarity"))


@register("extract_relevant_info")
def q_extract_relevant_info(spark, sf_dir):
    store = once(_store(spark, sf_dir), "store")
    return R.attach_content(R.rank_content(_questions(spark, sf_dir), store, DOC_KEYS), store, DOC_KEYS)


@register("generate_response")
def q_generate_response(spark, sf_dir):
    """Reference mode: each question ranked against a 1000-document sample."""
    questions, sample = _questions(spark, sf_dir), _sample(spark, sf_dir)
    ranked = R.rank_content(questions, sample, DOC_KEYS, candidates=R.SAMPLE_SIZE)
    return R.generate_response(questions, R.attach_content(ranked, sample, DOC_KEYS))


def answer_queries_df(spark, sf_dir) -> DataFrame:
    """The store is tokenised and written once; vectors and contents are read from it."""
    return R.answer_queries(_questions(spark, sf_dir), once(_store(spark, sf_dir), "store"), DOC_KEYS)


register("answer_queries")(answer_queries_df)


# ---------------------------------------------------------------------------
# Sources (S4-S8)
# ---------------------------------------------------------------------------

from lexis.operators import cleaning as C  # noqa: E402
from lexis.sources import files as SF  # noqa: E402


@register("line_documents")
def q_line_documents(spark, sf_dir):
    return line_documents(_t(spark, sf_dir, "documents"))


@register("total_documents")
def q_total_documents(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.agg(F.sum(TX.count_lines("text")).cast("bigint").alias("total_documents"),
                    F.count(F.lit(1)).cast("bigint").alias("files"))


@register("whole_file_text")
def q_whole_file_text(spark, sf_dir):
    return SF.as_text_files(_t(spark, sf_dir, "documents"))


@register("assemble_pages")
def q_assemble_pages(spark, sf_dir):
    pages = _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return SF.assemble_pages(pages)


@register("route_files")
def q_route_files(spark, sf_dir):
    return SF.route_files(SF.as_text_files(_t(spark, sf_dir, "documents"), SF.EXT_BY_LANG))


# ---------------------------------------------------------------------------
# Cleaning (C1-C13).  The fixture holds no controls, URLs, headers or page
# numbers, so each query injects them with an expression the oracle repeats.
# ---------------------------------------------------------------------------

INJECT_HEAD = "\x07 \u200b"                # bell, space, zero-width space
INJECT_TAIL = "\u00ad\x01 \x1f\u3000"     # soft hyphen, SOH, whitespace run
INJECT_LINE = "\x07\x08"                   # a line that cleans to nothing


def _dirty_documents(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.concat(
        F.lit(INJECT_HEAD), F.regexp_replace("text", "\n", F.lit(INJECT_TAIL + "\n")),
        F.lit("\n" + INJECT_LINE)).alias("text"))


def _raw_documents(spark, sf_dir) -> DataFrame:
    """Documents as bytes; German ones end in an invalid byte."""
    docs = _dirty_documents(spark, sf_dir)
    bad = F.when(F.col("lang") == "de", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return docs.select("doc_id", F.concat(F.encode("text", "UTF-8"), bad).alias("raw"))


@register("utf8_report")
def q_utf8_report(spark, sf_dir):
    raw = _raw_documents(spark, sf_dir)
    return raw.select("doc_id", C.utf8_valid("raw").alias("valid"),
                      C.decode_utf8("raw").alias("text"))


@register("clean_lines")
def q_clean_lines(spark, sf_dir):
    lines = line_documents(_dirty_documents(spark, sf_dir))
    return C.clean_lines(lines)


@register("cleaning_outcome")
def q_cleaning_outcome(spark, sf_dir):
    lines = C.raw_lines(_raw_documents(spark, sf_dir), "doc_id", "raw")
    return C.cleaning_outcome(lines, "documents.txt")


@register("verify_outcome")
def q_verify_outcome(spark, sf_dir):
    """The verify-only pass: nothing is cleaned, the copy goes beside the input."""
    lines = C.raw_lines(_raw_documents(spark, sf_dir), "doc_id", "raw")
    return C.cleaning_outcome(lines, "documents.txt", clean=False)


def _conversation_pages(spark, sf_dir) -> DataFrame:
    """Each conversation assembled with its turn number as a page-number line."""
    conv = _t(spark, sf_dir, "conversations")
    pages = conv.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"),
                        F.concat("text", F.lit("\n"), F.col("turn").cast("string"),
                                 F.lit("\n")).alias("text"))
    return SF.assemble_pages(pages, sep="")


@register("strip_page_numbers")
def q_strip_page_numbers(spark, sf_dir):
    pages = _conversation_pages(spark, sf_dir)
    return pages.select("doc", TX.strip_page_numbers("text").alias("text"))


def _with_headers(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(
        F.lit(TX.CHAPTER_MARKER + " "), F.col("doc_id").cast("string"), F.lit("\n"),
        F.regexp_replace("text", "\n", F.lit("\nx " + TX.CHAPTER_MARKER + " y\n")),
        F.lit("\n" + TX.CHAPTER_MARKER + " fim")).alias("text"))


@register("strip_headers")
def q_strip_headers(spark, sf_dir):
    return _with_headers(spark, sf_dir).select("doc_id", TX.strip_headers("text").alias("text"))


def _with_urls(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.lit("doc").alias("src"),
                                                  F.col("doc_id").alias("id"), "text")
    pages = _t(spark, sf_dir, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"),
        F.concat(F.lit("see "), F.col("url"), F.lit(" and "), F.col("url"),
                 F.lit("\tdone")).alias("text"))
    return docs.unionByName(pages)


@register("strip_urls")
def q_strip_urls(spark, sf_dir):
    return _with_urls(spark, sf_dir).select("src", "id", TX.strip_urls("text").alias("text"))


@register("strip_symbols")
def q_strip_symbols(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", TX.strip_symbols("text").alias("text"))


@register("collapse_ws")
def q_collapse_ws(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", TX.collapse_ws("text").alias("text"))


def _messy_documents(spark, sf_dir) -> DataFrame:
    """Headers, page numbers and URLs injected around every document."""
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(
        F.lit(TX.CHAPTER_MARKER + " "), F.col("doc_id").cast("string"), F.lit("\n"),
        F.regexp_replace("text", "\n", F.lit("\n7\n")),
        F.lit("\n"), F.col("n_chars").cast("string"), F.lit("\nsee http://x.example.org/d/"),
        F.col("doc_id").cast("string"), F.lit("?q=1, ok")).alias("text"))


@register("clean_text")
def q_clean_text(spark, sf_dir):
    return _messy_documents(spark, sf_dir).select("doc_id", TX.clean_text("text").alias("text"))


# ---------------------------------------------------------------------------
# Tokenisation (T1-T4) and vectors (V1-V5)
# ---------------------------------------------------------------------------

from lexis.operators import vectorize as V  # noqa: E402


@register("preprocess_text")
def q_preprocess_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", TX.preprocess_text("text").alias("text"))


#: Appended to every document by ``contractions``, and what it must become.
CONTRACTED = " I cannot, gonna wanna GIMME lemme gotta 'tis d'ye more'n cannot cannot Ñcannot"
EXPANDED = "i can not gon na wan na gim me lem me got ta is d more can not can not ñcannot"


@register("contractions")
def q_contractions(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.preprocess_text(F.concat("text", F.lit(CONTRACTED))).alias("text"))


@register("process_batch")
def q_process_batch(spark, sf_dir):
    return _store(spark, sf_dir)


@register("term_tokens")
def q_term_tokens(spark, sf_dir):
    return V.explode_terms(_t(spark, sf_dir, "documents"), ["doc_id"], "text")


@register("term_frequency")
def q_term_frequency(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return V.term_frequency(docs, ["doc_id"], "text")


@register("hashed_tf")
def q_hashed_tf(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return V.hashed_tf(docs, ["doc_id"], "text")


@register("hashing_tf_ml")
def q_hashing_tf_ml(spark, sf_dir):
    """V3 with the built-in ML transformer (murmur3 buckets; rows-only check)."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return V.ml_hashed_tf(docs, ["doc_id"], "text")


@register("tf_l2")
def q_tf_l2(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    vec = V.l2_normalize(V.vectors(docs, ["doc_id"], "text"))
    return vec.select("doc_id", "feature", F.round("weight", 6).alias("weight"))


@register("cosine_terms")
def q_cosine_terms(spark, sf_dir):
    """Cosine between each stored line and the next line of its document."""
    pairs = line_pairs(_t(spark, sf_dir, "documents"))
    return V.adjacent_cosine(pairs, "doc_id", "line_no", "content", lowercase=False)


@register("cosine_dense")
def q_cosine_dense(spark, sf_dir):
    """Cosine between each embedding and the one with the next id."""
    emb = _t(spark, sf_dir, "embeddings")
    return V.next_row_dense_cosine(emb, "vec_id", "embedding")


# ---------------------------------------------------------------------------
# Web pages (W1-W11, S12)
# ---------------------------------------------------------------------------

from lexis.functions import html as HT  # noqa: E402
from lexis.operators import web as W  # noqa: E402


@register("page_text")
def q_page_text(spark, sf_dir):
    return W.page_text(_t(spark, sf_dir, "pages"))


def _pages_some_without_body(spark, sf_dir) -> DataFrame:
    """Plain-http pages lose their <body> tags (so they have no body)."""
    pages = _t(spark, sf_dir, "pages")
    stripped = F.regexp_replace("html", r"(?i)</?body[^>]*>", "")
    return pages.select("page_id", "url", F.when(F.col("url").startswith("http://"), stripped)
                        .otherwise(F.col("html")).alias("html"))


@register("pages_without_body")
def q_pages_without_body(spark, sf_dir):
    return W.pages_without_body(_pages_some_without_body(spark, sf_dir))


@register("page_title")
def q_page_title(spark, sf_dir):
    return W.page_titles(_t(spark, sf_dir, "pages")).select("page_id", "title")


@register("page_filename")
def q_page_filename(spark, sf_dir):
    return W.page_titles(_t(spark, sf_dir, "pages")).select("page_id", "file_name")


@register("page_links")
def q_page_links(spark, sf_dir):
    return W.page_links(_t(spark, sf_dir, "pages"))


@register("page_links_by_page")
def q_page_links_by_page(spark, sf_dir):
    return W.page_links(_t(spark, sf_dir, "pages"), base=None)


@register("internal_links")
def q_internal_links(spark, sf_dir):
    return W.internal_links(_t(spark, sf_dir, "pages"), base=None)


@register("visitable_urls")
def q_visitable_urls(spark, sf_dir):
    return W.visitable_urls(_t(spark, sf_dir, "pages"))


@register("crawl_frontier")
def q_crawl_frontier(spark, sf_dir):
    return W.crawl_frontier(_t(spark, sf_dir, "pages"), base=None)


GROUP = 8  # pages of a ring of derived edges


def _rings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Edges and seeds: the fixture's links lead to no stored page, so every
    GROUP consecutive pages are also linked in a ring (chains with a cycle), and
    the crawl starts at each ring's first page."""
    pages = _t(spark, sf_dir, "pages").filter(~HT.has_fragment("url"))
    ring = (pages.groupBy(F.floor(F.col("page_id") / GROUP).alias("g"))
            .agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("_p"))  # GROUP rows at most
            .select(F.col("_p.url").alias("urls")))
    at = ring.select("urls", F.posexplode("urls").alias("i", "src"))
    edges = at.select("src", F.element_at("urls", (F.col("i") + 1) % F.size("urls") + 1).alias("dst"))
    return edges, ring.select(F.element_at("urls", 1).alias("url"))


@register("crawl_reachable")
def q_crawl_reachable(spark, sf_dir):
    """Closure over link and ring edges."""
    ring, seeds = _rings(spark, sf_dir)
    edges = W.link_edges(_t(spark, sf_dir, "pages"), base=None).unionByName(ring).distinct()
    return W.crawl_reachable(edges, seeds).select("url")


#: Put before every page, and in place of its <body>; ``page_markup`` must not see the title
#: and the bodies, and must show the rest as MARKUP_TEXT, with MARKUP_LINK as its first link.
MARKUP_HEAD = "<script>var t='<title>bad</title>';</script><!-- <body> <title>no</title> -->"
MARKUP_BODY = ("<body data-x=\"a>b\"><!-- <script> --><p title='x>y'>caf&#233; &#x41;&amp;#66;&#0;</p><script>x</script>"
               "<p>1 < 2 and 3 > 2</p><style media=\"a>b\">p{}</style><a title=\"x>y\" href=\"/lost\">there</a>")
MARKUP_TEXT = "café A&#66;&#0;\n1 < 2 and 3 > 2\nthere"
MARKUP_LINK = "/lost"


@register("page_markup")
def q_page_markup(spark, sf_dir):
    html = F.concat(F.lit(MARKUP_HEAD), F.regexp_replace("html", r"(?i)<body[^>]*>", F.lit(MARKUP_BODY)))
    pages = W.scanned(_t(spark, sf_dir, "pages").withColumn("html", html))
    return pages.filter(HT.has_body("nodes")).select(
        "page_id", HT.page_title("nodes").alias("title"), HT.body_text("nodes").alias("text"),
        F.get(HT.anchor_hrefs("nodes"), F.lit(0)).alias("first_link"))


@register("page_documents")
def q_page_documents(spark, sf_dir):
    return W.page_documents(_t(spark, sf_dir, "pages"))


@register("crawl_report")
def q_crawl_report(spark, sf_dir):
    return W.crawl_report(_t(spark, sf_dir, "pages"))


# ---------------------------------------------------------------------------
# Clustering (K1-K5) on the 64-d embeddings
# ---------------------------------------------------------------------------

from lexis.operators import cluster as K  # noqa: E402
from lexis.operators import packed as P  # noqa: E402


def _emb(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings")


@register("kmeans_init")
def q_kmeans_init(spark, sf_dir):
    return K.to_long(K.init_centroids(_emb(spark, sf_dir), "vec_id", "embedding"))


@register("cluster_assign")
def q_cluster_assign(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return K.assign_points(emb, "vec_id", "embedding", once(K.init_centroids(emb, "vec_id", "embedding")))


@register("kmeans_update")
def q_kmeans_update(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    init = once(K.init_centroids(emb, "vec_id", "embedding"))
    return K.to_long(K.update(emb, "vec_id", "embedding", init))


@register("kmeans_batch")
def q_kmeans_batch(spark, sf_dir):
    return K.batch_kmeans(_emb(spark, sf_dir), "vec_id", "embedding", k=K.N_CLUSTERS)


def _text_vectors(spark, sf_dir) -> DataFrame:
    """Vectors of whole documents, a row each, kept once."""
    return P.vector_table(_t(spark, sf_dir, "documents"), ["doc_id"], "text")


def _text_model(spark, sf_dir):
    wvec = _text_vectors(spark, sf_dir)
    cents = once(K.sparse_init(wvec, ["doc_id"]), "model")
    terms, apart = K.assigned_terms(wvec, ["doc_id"], cents)
    terms = once(terms, "assigned")
    return terms, cents, K.assigned_docs(_t(spark, sf_dir, "documents"), terms, apart, ["doc_id"])


@register("text_kmeans_init")
def q_text_kmeans_init(spark, sf_dir):
    cents = K.sparse_init(_text_vectors(spark, sf_dir), ["doc_id"])
    return cents.select("cluster_id", "feature", F.round("value", 6).alias("value"))


@register("text_cluster_assign")
def q_text_cluster_assign(spark, sf_dir):
    return _text_model(spark, sf_dir)[2]


@register("text_kmeans_update")
def q_text_kmeans_update(spark, sf_dir):
    wvec, cents, assignment = _text_model(spark, sf_dir)
    new_c, new_w = K.sparse_update(wvec, once(assignment, "assignment"), ["doc_id"], cents, None)
    return new_c.join(new_w, "cluster_id").select("cluster_id", "weight", "feature", F.round("value", 6).alias("value"))


@register("kmeans_parallel_init")
def q_kmeans_parallel_init(spark, sf_dir):
    return K.parallel_seeds(_text_vectors(spark, sf_dir), ["doc_id"])


BATCH_ROUNDS = 3  # of the registered query; the operator goes on until no document moves


@register("text_kmeans_batch")
def q_text_kmeans_batch(spark, sf_dir):
    """Lloyd's rounds over the documents' own vectors."""
    wvec = _text_vectors(spark, sf_dir)
    return K.lloyd(wvec, ["doc_id"], K.sparse_init(wvec, ["doc_id"]), BATCH_ROUNDS)[0]


@register("rank_in_cluster")
def q_rank_in_cluster(spark, sf_dir):
    """Per-label mean vectors as questions, answered inside their cluster."""
    emb = _emb(spark, sf_dir)
    return K.rank_in_cluster(K.label_means(emb, "label", "embedding"), emb, "vec_id",
                             "embedding", K.init_centroids(emb, "vec_id", "embedding"))


# ---------------------------------------------------------------------------
# Normalisation (T5-T9), store ids (S10), catalog (S1)
# ---------------------------------------------------------------------------

from lexis.operators import normalize as NZ  # noqa: E402
from lexis.operators.store import assign_ids  # noqa: E402


#: Surfaces with several lemmas: the first in order counts.
TWO_LEMMAS = [("en", "the", "thou"), ("en", "the", "thee"), ("de", "der", "dir"), ("de", "der", "derer")]


def _cleaned_normalized(spark, sf_dir, stop, lexicon) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return NZ.normalize_text(docs, "doc_id", "text", stop, lexicon, "lang", text_fn=TX.clean_text)


@register("remove_stopwords")
def q_remove_stopwords(spark, sf_dir):
    return _cleaned_normalized(spark, sf_dir, NZ.PORTUGUESE_STOP_WORDS, None)


@register("lemmatize")
def q_lemmatize(spark, sf_dir):
    return _cleaned_normalized(spark, sf_dir, None, NZ.DEFAULT_LEXICON + TWO_LEMMAS)


@register("lemmatize_with_table")
def q_lemmatize_with_table(spark, sf_dir):
    """The same lemmas from a lexicon table, by a join."""
    docs = _t(spark, sf_dir, "documents").withColumn("text", TX.clean_text("text"))
    table = spark.createDataFrame(NZ.DEFAULT_LEXICON + TWO_LEMMAS, "lang string, surface string, lemma string")
    return NZ.normalize_with_table(docs, "doc_id", "text", None, table, "lang")


@register("normalize_text")
def q_normalize_text(spark, sf_dir):
    return _cleaned_normalized(spark, sf_dir, NZ.PORTUGUESE_STOP_WORDS, NZ.DEFAULT_LEXICON)


def _routed_files(spark, sf_dir) -> DataFrame:
    """All documents as files, French ones .pdf (its pages are its lines), the
    rest .txt.  Each pair of neighbours shares a file stem, so pairs collide on
    their output name."""
    stem = (F.col("doc_id") - F.col("doc_id") % 2).cast("string")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), stem,
                    F.when(F.col("lang") == "fr", ".pdf").otherwise(".txt"))
    docs = _t(spark, sf_dir, "documents").select(path.alias("path"), "text", "lang")
    files = SF.route_files(docs, carry=["text", "lang"])
    paged = F.array_join(F.transform(TX.split_lines("text"), lambda p: F.concat(p, F.lit("\n"))), "")
    return files.withColumn("text", F.when(F.col("kind") == "pdf", paged).otherwise(F.col("text")))


@register("preprocess_files")
def q_preprocess_files(spark, sf_dir):
    return NZ.preprocess_files(_routed_files(spark, sf_dir), NZ.PORTUGUESE_STOP_WORDS, NZ.DEFAULT_LEXICON)


@register("document_store")
def q_document_store(spark, sf_dir):
    """The store with ids 1..N in insert order (document, then line)."""
    store = build_store(_t(spark, sf_dir, "documents"), ordered=True)
    return assign_ids(store, ["doc_id", "line_no"], partitioned=True) \
        .select("id", "doc_id", "line_no", "content")


# ---------------------------------------------------------------------------
# Lifecycle (L10; L5, L6, L8 and L9 read a trainer's own manifest, see tests)
# ---------------------------------------------------------------------------


from lexis.operators import lifecycle as L  # noqa: E402


@register("model_summary")
def q_model_summary(spark, sf_dir):
    return L.model_summary(_store(spark, sf_dir))


# ---------------------------------------------------------------------------
# Streaming (L1-L4, L7, R7).  Inputs are written by Spark from the fixture
# tables into a fresh folder under the shared checkpoint root.
# ---------------------------------------------------------------------------

def _corpus_files(docs: DataFrame, folder: str) -> str:
    """The documents' text as text files whose names follow the document ids.  Training reads them once: queries
    delete them when it ends, before the store is read."""
    with shuffles_freed(docs.sparkSession):
        (docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text")
             .write.mode("append").text(folder))
    return folder


def _completed(outcome: DataFrame) -> None:
    """A training that failed or was cut off leaves part of a store: nothing may be told from it."""
    row = outcome.first()
    if row["result"] != "completed":
        raise RuntimeError(f"training ended with {row['result']}: {row['error']}")


def _content_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("content").agg(F.count(F.lit(1)).alias("copies"))


@register("train_corpus")
def q_train_corpus(spark, sf_dir):
    """The trained store, as its contents and how often each is stored."""
    from lexis.streaming.train import CorpusTrainer
    root = scratch_path(spark, "train")
    trainer = CorpusTrainer(spark, f"{root}/state", max_files_per_trigger=8, clean_source=True)
    _completed(trainer.train(_corpus_files(_t(spark, sf_dir, "documents"), f"{root}/in")))
    delete_path(spark, f"{root}/in")
    return _content_counts(trainer.store())


@register("train_sliced")
def q_train_sliced(spark, sf_dir):
    """The same store from files that are cut: a file is many batches."""
    from lexis.streaming.train import CorpusTrainer
    root = scratch_path(spark, "sliced")
    folder = _corpus_files(_t(spark, sf_dir, "documents"), f"{root}/in")
    size = sum(f.getLen() for f in _files(spark, folder))
    trainer = CorpusTrainer(spark, f"{root}/state", slice_bytes=-(-size // 4) or 1, clean_source=True)
    _completed(trainer.train(folder))
    delete_path(spark, folder)
    return _content_counts(trainer.store())


def _files(spark, folder: str) -> list:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return list(where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


@register("increment_corpus")
def q_increment_corpus(spark, sf_dir):
    """Train corpus a, then b, then a with new files, then a again unchanged."""
    from lexis.streaming.train import CorpusTrainer
    root, docs = scratch_path(spark, "increment"), _t(spark, sf_dir, "documents")
    part = [docs.filter(F.coalesce(F.col("doc_id") % 3, F.lit(0)) == i) for i in range(3)]
    trainer = CorpusTrainer(spark, f"{root}/state")
    _completed(trainer.train(_corpus_files(part[0], f"{root}/a"), "a"))
    _completed(trainer.increment(_corpus_files(part[1], f"{root}/b"), "b"))
    _completed(trainer.increment(_corpus_files(part[2], f"{root}/a"), "a"))
    _completed(trainer.increment(f"{root}/a", "a"))
    for folder in ("a", "b"):
        delete_path(spark, f"{root}/{folder}")
    return _content_counts(trainer.store())


@register("train_then_answer")
def q_train_then_answer(spark, sf_dir):
    """Questions answered from a trainer's store and the vectors kept at ingest."""
    from lexis.streaming.train import CorpusTrainer
    root, questions = scratch_path(spark, "ask"), _questions(spark, sf_dir)
    trainer = CorpusTrainer(spark, f"{root}/state")
    _completed(trainer.train(_corpus_files(_t(spark, sf_dir, "documents"), f"{root}/in")))
    delete_path(spark, f"{root}/in")
    store = trainer.store()
    ranked = R.rank_content(questions, store, ["id"], doc_vectors=trainer.vector_rows())
    return R.generate_response(questions, R.attach_content(ranked, store, ["id"]))


@register("answer_by_clusters")
def q_answer_by_clusters(spark, sf_dir):
    """Questions answered cluster by cluster: the trainer's own model, its store and vectors."""
    from lexis.streaming.train import CorpusTrainer
    root, questions = scratch_path(spark, "cells"), _questions(spark, sf_dir)
    trainer = CorpusTrainer(spark, f"{root}/state")
    _completed(trainer.train(_corpus_files(_t(spark, sf_dir, "documents"), f"{root}/in")))
    delete_path(spark, f"{root}/in")
    store, docs = trainer.store(), trainer.vector_rows()
    cells = R.cluster_cells(docs, ["id"], trainer.model()[0])
    ranked = R.rank_by_clusters(questions, store, ["id"], docs, *cells)
    return R.generate_response(questions, R.attach_content(ranked, store, ["id"]))


@register("answer_stream")
def q_answer_stream(spark, sf_dir):
    """User turns of the conversations, streamed as questions."""
    from lexis.streaming.answer import prepare_store_tables, start_answer_stream
    root = scratch_path(spark, "answers")
    store_t, vec_t = prepare_store_tables(spark, _t(spark, sf_dir, "documents"), f"{root}/tables")
    conv = _t(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    qs = conv.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("query_id"),
                     F.col("text").alias("query"))
    qs.repartition(4).write.parquet(f"{root}/questions")
    # all questions that wait are one micro-batch, so one pass over the store serves them
    q = start_answer_stream(spark, f"{root}/questions", "query_id bigint, query string",
                            store_t, vec_t, f"{root}/sink", f"{root}/_ckpt")
    q.awaitTermination()
    for table in (store_t, vec_t):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for part in ("tables", "questions", "_ckpt"):
        delete_path(spark, f"{root}/{part}")
    return spark.read.parquet(f"{root}/sink").select("query_id", "answer")
