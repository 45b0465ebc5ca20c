"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.plans.registry import QueryFn
from ledgerspark.sources.tables import read_table

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return deco


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PREFERENCE_SQL = """
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
last AS (SELECT pair_id, max(turn) AS stop, arg_max(text, turn) AS answer FROM t WHERE role = 'assistant' GROUP BY 1),
ends AS (SELECT l.pair_id, l.stop, coalesce(o.answer, '') AS other FROM last l LEFT JOIN last o ON xor(o.pair_id, 1) = l.pair_id),
c AS (SELECT t.* FROM t JOIN ends USING (pair_id) WHERE turn <= stop),
r AS (SELECT t.* FROM t JOIN ends USING (pair_id) WHERE turn < stop
      UNION ALL SELECT pair_id, stop, 'assistant', other FROM ends),
b AS (SELECT pair_id, turn, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt,
             coalesce(c.role = r.role AND c.text = r.text, false) AS same
      FROM c FULL JOIN r USING (pair_id, turn)),
f AS (SELECT pair_id, min(turn) AS diff FROM b WHERE NOT same GROUP BY 1),
p AS (SELECT b.*, diff IS NULL OR turn < diff AS shared FROM b LEFT JOIN f USING (pair_id)),
s AS (SELECT pair_id, turn, 'prompt' AS part, cr AS role, ct AS text FROM p WHERE shared
      UNION ALL SELECT pair_id, turn, 'chosen', cr, ct FROM p WHERE NOT shared AND cr IS NOT NULL
      UNION ALL SELECT pair_id, turn, 'rejected', rr, rt FROM p WHERE NOT shared AND rr IS NOT NULL),
x AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail FROM s)
SELECT pair_id, part, turn, role, head || text || tail AS rendered,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) ELSE 0 END AS loss_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head || text || tail) - 1 ELSE 0 END AS loss_end
FROM x
"""


@register(_PREFERENCE_SQL)
def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations up to their last assistant turn (those without one give no row, as in the SQL)
    against their neighbour's last answer: one row per turn of prompt, chosen and rejected."""
    from ledgerspark.llm.preference import pairs_from_conversations, preference_segments

    return preference_segments(*pairs_from_conversations(read_table(spark, sf_dir, "conversations")))


@register(f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negated doc_id is the stable id, so the row with the largest doc_id stays."""
    from ledgerspark.llm.exact_dedup import dedup_report

    return dedup_report(read_table(spark, sf_dir, "documents"), stable_id=-F.col("doc_id"))


@register("""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, sum(n) OVER () * pow(n, 0.5) / sum(pow(n, 0.5)) OVER () / n AS rate FROM n),
m AS (SELECT source, greatest(1, ceil(rate / 16))::INT AS draws, rate / greatest(1, ceil(rate / 16)) AS mean FROM r),
k AS (SELECT source, draws, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::INT + 1)) AS k FROM m),
c AS (SELECT source, draws, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cum FROM k),
a AS (SELECT source, draws, list(cum) AS cdf FROM c GROUP BY 1, 2),
d AS (SELECT doc_id, text, documents.source, list_sum(list_transform(range(1, draws + 1), lambda j:
        len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('42|' || doc_id || '|' || j), 1, 13))::BIGINT / 4503599627370496.0)))) AS n_copies
      FROM documents JOIN a ON documents.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, source, text, unnest(range(1, n_copies::INT + 1))::INT AS copy, n_copies::INT AS n_copies FROM d
""")
def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources re-weighted by the square root of their size, as many rows as there were."""
    from ledgerspark.llm.mixing import replicate, source_rates

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return replicate(docs, source_rates(docs)).select("doc.*", "copy", "n_copies")


@register("""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
e AS (SELECT page_id, payload_bytes, h, list_reduce(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)),
        lambda x, y: x || y) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM e
""")
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, dedup the archive, and report the records read back from it."""
    from ledgerspark.llm.warc import dedup_pages

    return dedup_pages(read_table(spark, sf_dir, "pages"))[1].select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE pieces in sequences of 1024."""
    from ledgerspark.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


@register()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scanned by the patterns and by a network trained on their findings."""
    from ledgerspark.llm.secret_cnn import digest, scan, train

    docs = read_table(spark, sf_dir, "documents")
    return digest(scan(docs, train(docs)))


@register()
def op7_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probability and whether it is kept."""
    from ledgerspark.llm.quality import score, train

    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("__grade.score").alias("score"), F.col("__grade.expected").alias("expected_grade"),
                      F.col("__grade.tail").alias("tail_probability"), F.col("__grade.kept").alias("kept"))


@register()
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and its component of documents linked by Jaccard 0.8."""
    from ledgerspark.llm.jaccard import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"))


@register()
def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by keyed pseudonyms of the same format."""
    from ledgerspark.llm.pseudonym import pseudonymize

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, key="corpus-key-1")


@register()
def op10_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component at cosine 0.95."""
    from ledgerspark.llm.pivots import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


@register()
def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the tokenization automaton and decoded again."""
    import public_tokenizers

    from ledgerspark.llm.bpe_automaton import Vocabulary, decode, encode

    vocabulary = Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    both = decode(encode(read_table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@register()
def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of byte-level BPE with the piece model, scored by the corpus."""
    import public_tokenizers

    from ledgerspark.llm.alignment import align, pair_counts, scores

    aligned = align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                    public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False)
    return scores(aligned, pair_counts(aligned.postings)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"),
        "document_sum")


def _codes_sql(rounds: int = 4) -> str:
    """Codebooks by common table expressions, one for each round."""
    nearest = ("SELECT vec_id, p, min({{'d': list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, 'e': e}}) AS m "
               "FROM parts JOIN book{k} USING (p) GROUP BY vec_id, p")
    step = """
a{k} AS MATERIALIZED (""" + nearest + """),
s{k} AS (SELECT p, m.e AS e, j, floor(sum(v[j]) / count(*))::BIGINT AS x FROM a{k} JOIN parts USING (vec_id, p), range(1, 17) r(j) GROUP BY 1, 2, 3),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(u.w, b.w) AS w FROM book{k} b
  LEFT JOIN (SELECT p, e, list(x ORDER BY j) AS w FROM s{k} GROUP BY 1, 2) u USING (p, e)),"""
    return ("""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, q[p * 16 + 1 : p * 16 + 16] AS v FROM kept, range(0, 4) r(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS w FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256),""" + "".join(step.format(k=k, n=k + 1) for k in range(rounds))
            + "last AS (" + nearest.format(k=rounds) + """),
coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(list_aggregate(w, 'string_agg', ','), ',' ORDER BY p, e)) FROM book""" + str(rounds) + """) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)""")


@register(_codes_sql())
def op12_code_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as four codes, with errors and the codebooks' digest."""
    import hashlib

    from ledgerspark.llm.code_trie import compress
    from ledgerspark.llm.common import staged

    found = compress(read_table(spark, sf_dir, "embeddings"))
    codes = found.codes.select("row.vec_id", "row.label", "code", "error", F.size("numbers").alias("length"))
    by_label = staged(codes.groupBy(F.col("label").alias("__label"))
                      .agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum")), "trie-labels")
    digest = F.lit(None).cast("string")
    for n, book in found.codebooks.items():
        digest = F.when(F.col("length") == n, hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()).otherwise(digest)
    return codes.join(by_label, codes["label"].eqNullSafe(by_label["__label"])).select(
        "vec_id", F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error",
        F.least("__sum", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint").alias("label_error"),
        digest.alias("codebooks_sha256"))
