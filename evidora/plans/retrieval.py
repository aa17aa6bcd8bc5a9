"""Queries of ingest, retrieval, fusion and rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions import porter
from evidora.functions.text import tokens
from evidora.operators import index, ingest, rerank, retrieve, vectors
from evidora.plans.base import Tables, query

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: BM25 of every benchmark passage over every document: run(query_id, doc_id, score, rank), unlimited.
BM25 = (
    f"tk AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents), "
    "ln AS (SELECT doc_id, len(t) AS dl, t FROM tk), "
    "st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM ln), "
    f"qt AS (SELECT item_id AS query_id, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark), "
    "tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM ln) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), "
    "idf AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term), "
    "NAMEs AS (SELECT query_id, doc_id, round(sum(idf * tf * (K1 + 1) / (tf + K1 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM st)))), 6) AS score FROM tf JOIN idf USING (term) JOIN qt USING (term) GROUP BY ALL), "
    "NAME AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM NAMEs)"
)
RUN = BM25.replace("NAME", "run").replace("K1", "1.5")
KNN = (
    "vs AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score "
    "FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id AND {which}), "
    "vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM vs)"
)
VECTOR = KNN.format(which="q.vec_id IN (SELECT item_id FROM benchmark)")
LEGS = f"{RUN}, {VECTOR}, legs AS (SELECT query_id, doc_id, 'bm25' AS leg, rank, score FROM run WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, 'vector', rank, score FROM vr WHERE rank <= 100 AND doc_id IN (SELECT doc_id FROM documents))"
RRF = LEGS + ", rf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM legs GROUP BY ALL), rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM rf), pool AS (SELECT * FROM rrf WHERE rank <= 50)"
#: Relevance of pooled candidates: idf-weighted share of the query's terms that the document has. Publication year: synthetic, 2000 + doc_id % 25.
REL = (
    RRF + ", qw AS (SELECT query_id, sum(idf) AS w FROM qt JOIN idf USING (term) GROUP BY query_id), "
    "hit AS (SELECT p.query_id, p.doc_id, sum(idf) AS h FROM pool p JOIN qt USING (query_id) JOIN tf ON tf.term = qt.term AND tf.doc_id = p.doc_id JOIN idf ON idf.term = qt.term GROUP BY ALL), "
    "rel AS (SELECT p.query_id, p.doc_id, p.score AS fused, p.rank AS pool_rank, round(coalesce(h, 0) / w, 6) AS rel, (2000 + p.doc_id % 25)::BIGINT AS year FROM pool p JOIN qw USING (query_id) LEFT JOIN hit USING (query_id, doc_id))"
)
LAST = ", run2 AS (SELECT query_id, doc_id, rel, year, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, year DESC, doc_id)::BIGINT AS rank FROM rel)"


# ---- sources and ingest ------------------------------------------------------------------


@query("scan_pages_title", r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(html)::BIGINT AS n_chars FROM pages")
def scan_pages_title(t: Tables) -> DataFrame:
    return ingest.page_titles(t.pages)


STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?si)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("parse_strip_markup", f"SELECT page_id, {STRIP} AS body FROM pages")
def parse_strip_markup(t: Tables) -> DataFrame:
    return ingest.strip_pages(t.pages)


@query("parse_sections", r"WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<(p|h1|h2|h3|li|td|pre)(?: [^>]*)?>[^<]*', 0) AS parts FROM pages), s AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM p) SELECT page_id, pos::BIGINT AS pos, regexp_extract(part, '<(p|h1|h2|h3|li|td|pre)', 1) AS label, trim(regexp_replace(part, '(?s)<[^>]*>', '', 'g')) AS body FROM s")
def parse_sections(t: Tables) -> DataFrame:
    return ingest.sections(t.pages)


CHUNKS = r"w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents), n AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(greatest(1, ceil((len(ws) - 64) / 448.0)::BIGINT))) AS chunk_no FROM w), chunks AS (SELECT doc_id, chunk_no::BIGINT AS chunk_no, array_to_string(ws[chunk_no * 448 + 1 : chunk_no * 448 + 512], ' ') AS text, len(ws[chunk_no * 448 + 1 : chunk_no * 448 + 512])::BIGINT AS n_tokens FROM n)"


@query("chunk_512_64", f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_512_64(t: Tables) -> DataFrame:
    return ingest.chunks(t.documents)


@query("chunk_stats", f"WITH {CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(count(*) / count(DISTINCT doc_id), 6) AS chunks_per_doc, round(avg(n_tokens), 6) AS avg_tokens, max(n_tokens) AS max_tokens FROM chunks")
def chunk_stats(t: Tables) -> DataFrame:
    return ingest.chunk_stats(ingest.chunks(t.documents))


@query("data_audit", "SELECT lang, count(*) AS n_docs, count(DISTINCT text) AS n_texts, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_empty, count(*) FILTER (WHERE length(text) <> n_chars) AS n_wrong_length, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, round(avg(length(text)), 6) AS mean FROM documents GROUP BY lang")
def data_audit(t: Tables) -> DataFrame:
    return ingest.audit(t.documents)


@query("unit_audit", f"WITH {CHUNKS} SELECT lang, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_articles FROM chunks JOIN documents USING (doc_id) GROUP BY lang")
def unit_audit(t: Tables) -> DataFrame:
    return ingest.chunks(t.documents).join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_blocks"), F.countDistinct("doc_id").alias("n_articles"))


SAMPLE = "b AS (SELECT doc_id, lang, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 AS bucket FROM documents), r AS (SELECT lang, source, count(*) AS n, CASE WHEN lang = 'en' THEN 433 ELSE 866 END AS rate FROM documents GROUP BY ALL), sample AS (SELECT doc_id, b.lang, b.source, bucket FROM b JOIN r ON b.lang = r.lang AND b.source = r.source WHERE bucket < rate)"


@query("sample_stratified", f"WITH {SAMPLE} SELECT * FROM sample")
def sample_stratified(t: Tables) -> DataFrame:
    return ingest.stratified(t.documents, ingest.rates(t.documents))


@query("sample_coverage", f"WITH {SAMPLE}, {CHUNKS} SELECT s.lang, count(DISTINCT s.doc_id) AS n_docs, count(*) AS n_chunks, round(count(*) / count(DISTINCT s.doc_id), 6) AS per_doc FROM sample s JOIN chunks USING (doc_id) GROUP BY s.lang")
def sample_coverage(t: Tables) -> DataFrame:
    s = ingest.stratified(t.documents, ingest.rates(t.documents)).select("doc_id", "lang")
    out = ingest.chunks(t.documents).join(s, "doc_id").groupBy("lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"))
    return out.withColumn("per_doc", F.round(F.col("n_chunks") / F.col("n_docs"), 6))


@query("embed_hashing")
def embed_hashing(t: Tables) -> DataFrame:
    """The stand-in encoder: no embedding model is part of this library."""
    return ingest.embed(t.documents.select("doc_id", "text"), ingest.HashingEncoder(64))


@query("vec_norm", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norm(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(ingest.norm(F.col("embedding")), 6).alias("norm"))


@query("vec_stats", "SELECT count(*) AS n, max(len(embedding))::BIGINT AS dims, min(len(embedding))::BIGINT AS least_dims, count(DISTINCT label) AS n_labels FROM embeddings")
def vec_stats(t: Tables) -> DataFrame:
    return t.embeddings.agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dims"), F.min(F.size("embedding")).cast("long").alias("least_dims"), F.countDistinct("label").alias("n_labels"))


# ---- index and legs ----------------------------------------------------------------------


@query("tokenize_tf", f"WITH x AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL")
def tokenize_tf(t: Tables) -> DataFrame:
    return retrieve.postings(t.documents).select("doc_id", "term", "tf")


@query("stem_suffix", f"WITH x AS (SELECT DISTINCT unnest({TOK.format('text')}) AS term FROM documents) SELECT CASE WHEN length(term) >= 6 THEN regexp_replace(term, '(ations|ation|ings|ing|edly|ed|ers|er|ly|es|s)$', '') ELSE term END AS stem, count(*) AS n_terms FROM x GROUP BY ALL")
def stem_suffix(t: Tables) -> DataFrame:
    from evidora.functions.text import stem

    terms = t.documents.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return terms.groupBy(stem(F.col("term")).alias("stem")).agg(F.count("*").alias("n_terms"))


@query("stem_porter", f"WITH v AS (SELECT DISTINCT unnest({TOK.format('text')}) AS word FROM documents) " + porter.stem_sql("v"))
def stem_porter(t: Tables) -> DataFrame:
    """The stem of each distinct token."""
    return porter.stemmed(t.documents.select(F.explode(tokens(F.col("text"))).alias("word")).distinct(), "word", "stem")


POST = f"x AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents), post AS (SELECT term, doc_id, count(*) AS tf FROM x GROUP BY ALL)"


@query("index_postings", f"WITH {POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, min(doc_id) AS first_doc, max(tf) AS max_tf FROM post GROUP BY term")
def index_postings(t: Tables) -> DataFrame:
    return retrieve.postings(t.documents).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("doc_id").alias("first_doc"), F.max("tf").alias("max_tf"))


@query("index_df", f"WITH {POST} SELECT df, count(*) AS n_terms, sum(cf)::BIGINT AS cf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term) GROUP BY df")
def index_df(t: Tables) -> DataFrame:
    return retrieve.term_stats(retrieve.postings(t.documents)).groupBy("df").agg(F.count("*").alias("n_terms"), F.sum("cf").alias("cf"))


@query("bm25_topk", f"WITH {RUN} SELECT query_id, doc_id, score, rank FROM run WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return retrieve.bm25(t.documents, t.benchmark)


def store_of(t: Tables) -> index.Index:
    """The index of the documents: built once a session, by the first query that asks for it."""
    return index.stored(t.documents, t._dir)


@query("index_bm25_topk", f"WITH {RUN} SELECT query_id, doc_id, score, rank FROM run WHERE rank <= 10")
def index_bm25_topk(t: Tables) -> DataFrame:
    """The same ten as bm25_topk, from the stored index and only of the blocks that can matter."""
    return index.search(store_of(t), t.benchmark)


@query("index_terms", f"WITH {POST}, n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM post GROUP BY term")
def index_terms(t: Tables) -> DataFrame:
    """The term table of the store."""
    return store_of(t).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("knn_cosine", f"WITH {KNN.format(which='q.vec_id % 20 = 0')} SELECT query_id, doc_id, score, rank FROM vr WHERE rank <= 10")
def knn_cosine(t: Tables) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, against all."""
    return retrieve.knn(t.embeddings, t.embeddings.where("vec_id % 20 = 0")).select("query_id", "doc_id", "score", "rank")


@query("knn_lsh")
def knn_lsh(t: Tables) -> DataFrame:
    """Approximate neighbours of the same queries, from hash tables of random projections."""
    return ingest.knn_lsh(t.embeddings, t.embeddings.where("vec_id % 20 = 0"))


@query("knn_ivfpq")
def knn_ivfpq(t: Tables) -> DataFrame:
    """The ten nearest vectors that an inverted file with product codes finds, of the same queries; tests hold it against knn_cosine."""
    return vectors.knn(t.embeddings, t.embeddings.where("vec_id % 20 = 0")).select("query_id", "doc_id", "score", "rank")


def vector_leg(t: Tables, k: int = 100, among: DataFrame | None = None) -> DataFrame:
    """A passage's vector is the one with its id (a synthetic link); hits must be documents."""
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    store = t.embeddings if among is None else among
    run = retrieve.knn(store, q, k).join(t.documents.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "rank", "score")
    return retrieve.guarded(run, store, "the vector store")


def both_legs(t: Tables, **more: DataFrame) -> DataFrame:
    return retrieve.union_legs(bm25=retrieve.guarded(retrieve.bm25(t.documents, t.benchmark, 100), t.documents, "the corpus"), vector=vector_leg(t), **more)


def pool(t: Tables) -> DataFrame:
    return retrieve.fuse_rrf(both_legs(t)).where("rank <= 50")


@query("recall_union", f"WITH {LEGS} SELECT query_id, doc_id, leg, rank, score FROM legs")
def recall_union(t: Tables) -> DataFrame:
    return both_legs(t)


#: Landmark documents are synthetic: ids divisible by 97. Their leg has the three nearest of them by vector.
LANDMARKS = f"{LEGS}, lv AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM vs WHERE doc_id % 97 = 0), legs3 AS (SELECT query_id, doc_id, leg, rank, score FROM legs UNION ALL SELECT query_id, doc_id, 'landmark', rank, score FROM lv WHERE rank <= 3 AND doc_id IN (SELECT doc_id FROM documents))"


def landmark_leg(t: Tables, k: int = 3) -> DataFrame:
    """The nearest documents of the landmark collection, whatever else there is."""
    return vector_leg(t, k, t.embeddings.where("vec_id % 97 = 0"))


@query("recall_landmarks", f"WITH {LANDMARKS} SELECT query_id, doc_id, leg, rank, score FROM legs3")
def recall_landmarks(t: Tables) -> DataFrame:
    return both_legs(t, landmark=landmark_leg(t))


@query("fuse_landmarks", f"WITH {LANDMARKS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM legs3 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM f")
def fuse_landmarks(t: Tables) -> DataFrame:
    return retrieve.fuse_rrf(recall_landmarks(t)).select("query_id", "doc_id", "score", "rank")


@query("recall_counts", f"WITH {LEGS} SELECT query_id, count(DISTINCT doc_id) AS n_candidates, count(*) FILTER (WHERE leg = 'bm25') AS n_bm25, count(*) FILTER (WHERE leg = 'vector') AS n_vector FROM legs GROUP BY query_id")
def recall_counts(t: Tables) -> DataFrame:
    return both_legs(t).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_candidates"), F.count(F.when(F.col("leg") == "bm25", 1)).alias("n_bm25"), F.count(F.when(F.col("leg") == "vector", 1)).alias("n_vector"))


@query("fuse_rrf", f"WITH {RRF} SELECT query_id, doc_id, score, rank FROM rrf")
def fuse_rrf(t: Tables) -> DataFrame:
    return retrieve.fuse_rrf(both_legs(t)).select("query_id", "doc_id", "score", "rank")


@query("fuse_weighted", f"WITH {LEGS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM legs WINDOW w AS (PARTITION BY query_id, leg)), f AS (SELECT query_id, doc_id, round(sum(0.5 * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END), 6) AS score FROM m GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM f")
def fuse_weighted(t: Tables) -> DataFrame:
    return retrieve.fuse_weighted(both_legs(t), {"bm25": 0.5, "vector": 0.5}).select("query_id", "doc_id", "score", "rank")


@query("fuse_simple", f"WITH {LEGS}, g AS (SELECT query_id, doc_id, min(rank * 2 + (leg = 'bm25')::INT) AS b FROM legs GROUP BY ALL) SELECT query_id, doc_id, (b // 2)::BIGINT AS best_rank, CASE b % 2 WHEN 0 THEN 'vector' ELSE 'bm25' END AS leg, row_number() OVER (PARTITION BY query_id ORDER BY b, doc_id)::BIGINT AS rank FROM g")
def fuse_simple(t: Tables) -> DataFrame:
    return retrieve.fuse_simple(both_legs(t))


@query("leg_intersect", f"WITH {LEGS} SELECT query_id, doc_id FROM legs WHERE leg = 'bm25' INTERSECT SELECT query_id, doc_id FROM legs WHERE leg = 'vector'")
def leg_intersect(t: Tables) -> DataFrame:
    legs = both_legs(t)
    return legs.where("leg = 'bm25'").select("query_id", "doc_id").intersect(legs.where("leg = 'vector'").select("query_id", "doc_id"))


@query("leg_except", f"WITH {LEGS} SELECT query_id, doc_id FROM legs WHERE leg = 'bm25' EXCEPT ALL SELECT query_id, doc_id FROM legs WHERE leg = 'vector'")
def leg_except(t: Tables) -> DataFrame:
    legs = both_legs(t)
    return legs.where("leg = 'bm25'").select("query_id", "doc_id").exceptAll(legs.where("leg = 'vector'").select("query_id", "doc_id"))


@query("id_lookup", "SELECT item_id, doc_id, lang, source, n_chars FROM benchmark JOIN documents ON doc_id = item_id")
def id_lookup(t: Tables) -> DataFrame:
    """Queries anchored on identifiers: an equi-join that leaves the text column unread."""
    return t.benchmark.select("item_id").join(t.documents.select("doc_id", "lang", "source", "n_chars"), F.col("doc_id") == F.col("item_id"))


# ---- rerank ------------------------------------------------------------------------------


def relevance(t: Tables) -> DataFrame:
    return rerank.with_year(rerank.overlap(pool(t), t.documents, t.benchmark))


@query("rerank_pool", f"WITH {RRF} SELECT query_id, doc_id, score, rank FROM pool")
def rerank_pool(t: Tables) -> DataFrame:
    return pool(t).select("query_id", "doc_id", "score", "rank")


@query("rerank_overlap", f"WITH {REL} SELECT query_id, doc_id, rel FROM rel")
def rerank_overlap(t: Tables) -> DataFrame:
    return relevance(t).select("query_id", "doc_id", "rel")


@query("rerank_model", f"WITH {RRF}, n AS (SELECT p.query_id, p.doc_id, length(b.text) AS a, length(d.text) AS c FROM pool p JOIN benchmark b ON b.item_id = p.query_id JOIN documents d USING (doc_id)) SELECT query_id, doc_id, CASE WHEN greatest(a, c) > 0 THEN (least(a, c) * 1000000 // greatest(a, c)) / 1000000.0 ELSE 0 END AS rel FROM n")
def rerank_model(t: Tables) -> DataFrame:
    """The reranker protocol with its stand-in."""
    return rerank.reranked(pool(t), t.documents, t.benchmark, rerank.LengthRatio()).select("query_id", "doc_id", "rel")


@query("rerank_tiebreak", f"WITH {REL}{LAST} SELECT * FROM run2")
def rerank_tiebreak(t: Tables) -> DataFrame:
    return rerank.lexicographic(relevance(t)).select("query_id", "doc_id", "rel", "year", "rank")


@query("rerank_weighted", f"WITH {REL}, s AS (SELECT query_id, doc_id, round(0.7 * rel + 0.3 * (year - 2000) / 24.0, 8) AS score FROM rel) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM s")
def rerank_weighted(t: Tables) -> DataFrame:
    return rerank.weighted(relevance(t)).select("query_id", "doc_id", "score", "rank")


@query("rerank_relonly", f"WITH {REL} SELECT query_id, doc_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id)::BIGINT AS rank FROM rel")
def rerank_relonly(t: Tables) -> DataFrame:
    return rerank.relevance_only(relevance(t)).select("query_id", "doc_id", "rel", "rank")


@query("rerank_floor", f"WITH {REL}{LAST}, l AS (SELECT *, doc_id % 97 = 0 AS landmark FROM run2), p AS (SELECT *, CASE WHEN landmark AND rel >= 0.5 AND rank > 5 THEN 5.5 ELSE rank END AS place FROM l) SELECT query_id, doc_id, rel, landmark, rank AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY place, rank)::BIGINT AS rank FROM p")
def rerank_floor(t: Tables) -> DataFrame:
    """Landmarks are synthetic here: ids divisible by 97."""
    run = rerank.lexicographic(relevance(t)).withColumn("landmark", F.col("doc_id") % 97 == 0)
    return rerank.landmark_floor(run, 5, 0.5).select("query_id", "doc_id", "rel", "landmark", "old_rank", "rank")


@query("check_sort_contract", f"WITH {REL}{LAST}, g AS (SELECT *, lag(rel) OVER w AS p, lag(year) OVER w AS py FROM run2 WINDOW w AS (PARTITION BY query_id ORDER BY rank)) SELECT query_id, count(*) AS n, count(*) FILTER (WHERE p < rel OR p = rel AND py < year) AS n_violations FROM g GROUP BY query_id")
def check_sort_contract(t: Tables) -> DataFrame:
    return rerank.sort_contract(rerank.lexicographic(relevance(t)))
