"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, collocations, exact_dedup, language_id, lm_scoring, mixing, near_dedup, spelling, topk, toxicity, training_order, url_filter
from docloom.session import small_batches, table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for operators that read texts in Python."""
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(texts(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(texts(spark, sf_dir), vocabulary())
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), vocabulary()), 256).alias("decoded_sha256"),
    )


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of op5's vocabulary fit 16 bits."""
    packed = bpe.encode(texts(spark, sf_dir), vocabulary(), then=training_order.packing(width=2))
    manifest = training_order.materialise_packed(packed, width=2)
    return training_order.read(manifest).select("slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", F.crc32("tokens").alias("tokens_crc32"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    made = chat.examples(turns.unionByName(extra))
    read = made.select(
        "conv_id", "example", "formatted",
        chat.unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"),
    )
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns_of = chat.read_back(F.col("longest"))
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    return per.select("conv_id", "formatted_chars", "loss", turns_of.alias("turns")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(texts(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(texts(spark, sf_dir))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    scored = lm_scoring.score(docs, lm_scoring.train(docs))
    return scored.select("doc_id", lm_scoring.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_mix_sources, op3_simhash_near_dedup, op4_url_filter, op5_bpe_codec, op6_voronoi_top_k, op7_training_order,
        op8_language_id, op9_chat_format, op10_exact_dedup, op11_collocations, op12_spelling_variants, op13_lm_scoring,
    )
}

_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_cases() -> str:
    cases = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{rule} {verdict}'")
    return "CASE " + " ".join(cases) + " END"


def _suffix_labels() -> str:
    """How many labels a host's suffix has."""
    by_size = [(n, [x for x in url_filter.SUFFIXES if x.count(".") + 1 == n]) for n in sorted({x.count(".") + 1 for x in url_filter.SUFFIXES}, reverse=True)]
    return "CASE " + " ".join(f"WHEN array_to_string(labels[-{n}:], '.') IN ({', '.join(map(repr, names))}) THEN {n}" for n, names in by_size) + " ELSE 1 END"


def _strength_sql(groups: str) -> str:
    return f"""
        SELECT rate, CASE WHEN most > 0 AND spread / most > 0
                          THEN least(greatest(most / spread - 1, {url_filter.LEAST_STRENGTH}), {url_filter.MOST_STRENGTH})
                          ELSE {url_filter.MOST_STRENGTH} END AS k
        FROM (SELECT p AS rate, R - N * p * p - p * (1 - p) * (G - 1) AS spread, p * (1 - p) * (N - Q / N - (G - 1)) AS most
              FROM (SELECT sum(n) AS N, coalesce(sum(bad) / sum(n), 0) AS p, count(*) AS G, sum(n * n) AS Q, sum(bad * bad / n) AS R FROM {groups}))"""


ORACLES: dict[str, str] = {
    "op2_mix_sources": f"""
        WITH quality AS (SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 1.0 ELSE 0.5 END AS weight
                         FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) IS NOT NULL),
        d AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                     -ln((CAST('0x' || md5('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || sha256(coalesce(text, ''))))[1:13] AS BIGINT) + 0.5) / 4503599627370496.0)
                       / coalesce(weight, {mixing.DEFAULT_WEIGHT}) AS key, sha256(coalesce(text, '')) AS sha
              FROM documents d LEFT JOIN quality USING (doc_id)),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
        c AS (SELECT *, {mixing.MOST_EPOCHS} * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM w),
        f AS (SELECT *, sum(source_size) OVER () AS total,
                     coalesce(sum(cap) OVER b, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
              FROM c WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (SELECT *, CAST(cap AS DOUBLE) * weights <= weight * CAST(total - cap_before AS DOUBLE) AS filled FROM f),
        h AS (SELECT *, total - coalesce(sum(cap) FILTER (WHERE filled) OVER (), 0) AS left_words, sum(weight) FILTER (WHERE NOT filled) OVER () AS left_weight FROM g),
        t AS (SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE CAST(left_words * weight AS DOUBLE) / CAST(left_weight AS DOUBLE) END AS target FROM h),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
        r AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
                     sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, sha ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(least(epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END, {mixing.MOST_EPOCHS}) * size AS BIGINT) AS taken
        FROM r""",
    "op4_url_filter": f"""
        WITH u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        b AS (SELECT {_HOST} AS host, lower(url) AS url, html,
                     regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS said,
                     regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS parts FROM pages),
        w AS (SELECT *, greatest(len(regexp_extract_all(said, '[^\x20\x09-\x0D]+')), 1) AS words FROM b),
        o AS (SELECT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels,
                     coalesce(regexp_matches(url, '[./-]({"|".join(url_filter.SEED_NAMES)})([./-]|$)'), false)
                     OR coalesce(len(regexp_extract_all(said, '[%#*$]{{3}}|(&amp;){{3}}')) / words >= {url_filter.JUNK} OR len(regexp_extract_all(said, '!!')) / words >= {url_filter.SHOUTED}
                                 OR len(regexp_extract_all(html, '<a[\\s>]')) / words >= {url_filter.LINKS}
                                 OR len(parts) > 0 AND 1 - len(list_distinct(parts)) / greatest(len(parts), 1) >= {url_filter.REPEATED}, false) AS bad FROM w),
        q AS (SELECT *, {_suffix_labels()} AS k FROM o),
        h AS (SELECT host, array_to_string(labels[-least(k + 1, len(labels)):], '.') AS domain, array_to_string(labels[-least(k, len(labels)):], '.') AS suffix,
                     CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS DOUBLE) AS bad FROM q GROUP BY ALL),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
        ks AS ({_strength_sql("s")}), kd AS ({_strength_sql("d")}), kh AS ({_strength_sql("h")}),
        sm AS (SELECT suffix, (bad + ks.k * ks.rate) / (n + ks.k) AS mean FROM s, ks),
        dm AS (SELECT d.domain, (d.bad + kd.k * sm.mean) / (d.n + kd.k) AS mean FROM d JOIN sm USING (suffix), kd),
        hm AS (SELECT host, n, kh.k, (bad + kh.k * dm.mean) / (n + kh.k) AS mean FROM h JOIN dm USING (domain), kh),
        j AS (SELECT page_id, host, path, {_rule_cases()} AS fit,
                     mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (n + k + 1)) > {url_filter.THRESHOLD} AS blocked
              FROM u LEFT JOIN (SELECT host AS known, n, k, mean FROM hm) ON host = known)
        SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN string_split(fit, ' ')[1] END AS rule,
               CASE WHEN fit IS NOT NULL THEN string_split(fit, ' ')[2] WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
        FROM j""",
    "op6_voronoi_top_k": """
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS place, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
        s AS (SELECT q.place, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
              FROM v q JOIN v d ON q.place <> d.place WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op9_chat_format": r"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
                      UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        shown AS (SELECT *, row_number() OVER o AS place,
                         length('<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10)
                                || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)) AS chars
                  FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto,
                          max(place) OVER (PARTITION BY conv_id) AS last FROM shown)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(CASE WHEN role = 'assistant' OR place = last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM summed GROUP BY conv_id""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces WHERE regexp_matches(piece, '[^\x20\x09]')),
        held AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM (
          SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase FROM words, range(1, 6) s(size)) GROUP BY ALL HAVING count(*) >= 100),
        total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
        longer AS (SELECT DISTINCT h.lang, h.phrase FROM held h JOIN (
          SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:size - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM held WHERE size > 2) x
          ON x.lang = h.lang AND x.phrase = h.phrase AND x.f >= h.f),
        cuts AS (SELECT lang, size, phrase, f AS a, unnest(range(1, size)) AS k FROM held WHERE size > 1 AND (lang, phrase) NOT IN (SELECT lang, phrase FROM longer)),
        scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n, CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
          FROM cuts c JOIN held l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:c.k], ' ')
          JOIN held r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[c.k + 1:], ' ') JOIN total t ON t.lang = c.lang),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM weakest
        QUALIFY rank <= 2000""",
}
