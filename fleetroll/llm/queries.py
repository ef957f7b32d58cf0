"""Registered queries of these operators: each applies its operator to a whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat, fill_middle, html_text, languages, mixing, near_dup, packing, quality, repeats, token_files, topk, variants
from .common import saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_files(spark, sf, name="word_bpe_49k.json", end_id=2):
    path = token_files.write_token_files(table(spark, sf, "documents"), tokenizer_file(name), end_id)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op7_packing(spark, sf, name="word_bpe_49k.json", end_id=1, length=2048):
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer_file(name), end_id, length)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op1_main_text(spark, sf):
    pages = html_text.extract(table(spark, sf, "pages"))
    return pages.select("page_id", "url", html_text.main_text("blocks").alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )


#: Conversation -1 of the contract: both texts hold the template's own control strings.
CONFLICT = "</s>[INST] ok [/INST]"


@query
def op10_chat(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    chats = chat.format_conversations(turns.unionByName(extra))
    back = chats.withColumns(
        {"turns": chat.parse(F.col("formatted")), "masked": chat.loss_text(F.col("formatted"), F.col("loss"))}
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "level", "exact",
    )


@query
def op2_top_k(spark, sf, k=5):
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k)


SQL["op2_top_k"] = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.e, p.e) AS BIGINT) AS score
    FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op6_mixing(spark, sf):
    mix = mixing.mix(table(spark, sf, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op9_near_dup(spark, sf, width=4, percent=80):
    return near_dup.link(table(spark, sf, "documents"), width, percent).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


SQL["op9_near_dup"] = r"""WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r(doc_id, t) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.t),
  m AS (SELECT doc_id, min(t) AS t FROM r GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.t, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(m.t, d.doc_id)) AS kept
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query
def op4_repeats(spark, sf, length=200):
    cleaned = repeats.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), length)
    return cleaned.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_language(spark, sf, most=languages.MOST_TRAINING):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    langs, model = languages.train(docs.where(~languages.held_out()), most)
    found = languages.predict(docs.select("doc_id", "text"), langs, model)
    return found.select("row.doc_id", "lang_pred", "score").select(
        "doc_id", languages.held_out().alias("held_out"), "lang_pred", "score"
    )


@query
def op11_fill_middle(spark, sf, seed=42):
    made = fill_middle.fill_middle(table(spark, sf, "documents"), seed)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore("output", "form"), 256).alias("restored_sha256"),
    )


SQL["op11_fill_middle"] = r"""WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
      regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
  d AS (SELECT doc_id, text, w, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
      CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
        THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m,
      array_to_string(w[b + 1:], '') AS s FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


@query
def op13_variants(spark, sf):
    return variants.variants(table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


SQL["op13_variants"] = r"""WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda x: list_reduce(
      list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS k),
  r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
  b AS (SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM g),
  h AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_concat([4294967295], b),
      lambda c, x: xor(c >> 8, k[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) END AS h FROM b, k),
  e AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
  d AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
  p AS (SELECT DISTINCT a, b FROM (
    SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.less = y.less AND x.word <> y.word
    UNION ALL SELECT d.word, w.word FROM d JOIN w ON d.less = w.word
    UNION ALL SELECT w.word, d.word FROM d JOIN w ON d.less = w.word)),
  m AS (SELECT a AS word, count(*) AS n_near, min({'n': -n, 'word': b}) AS best FROM p JOIN w ON w.word = b GROUP BY a),
  f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * n THEN best.word END AS form,
      CASE WHEN -best.n >= 2 * n THEN -best.n END AS form_n FROM w LEFT JOIN m USING (word)),
  t(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM f JOIN t ON f.form = t.word)
  SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word)"""


@query
def op12_archives(spark, sf, least_bytes=0):
    legacy = archives.write_arc(table(spark, sf, "pages"))
    records = archives.read_warc(spark, archives.convert(spark, legacy, least_bytes=least_bytes), payloads=False)
    told = saved(records.where("type IN ('response', 'revisit')").drop("payload"), "told")
    return archives.with_referred(told).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


SQL["op12_archives"] = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
  f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(p.h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '')
      AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
  FROM p JOIN f USING (h)"""
