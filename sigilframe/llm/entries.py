"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), piece_model())


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"))


def op3_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_quality_rules

    return apply_quality_rules(table(spark, sf_dir, "documents"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_encoding import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), piece_model())


def op5_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op6_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_tree import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op7_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_overlap

    return benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_forest import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard_tree import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curve_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), byte_tokenizer())


def op12_rank_select_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fim_digests

    return fim_digests(table(spark, sf_dir, "documents"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_automata import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_trie_tokens": op1_trie_tokens,
    "op2_weak_quality": op2_weak_quality,
    "op3_adaptive_rules": op3_adaptive_rules,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_language_backoff": op5_language_backoff,
    "op6_site_tree": op6_site_tree,
    "op7_benchmark_overlap": op7_benchmark_overlap,
    "op8_jaccard_forest": op8_jaccard_forest,
    "op9_licence_scan": op9_licence_scan,
    "op10_shard_tree": op10_shard_tree,
    "op11_curve_packing": op11_curve_packing,
    "op12_rank_select_middle": op12_rank_select_middle,
    "op13_phrase_automata": op13_phrase_automata,
}

#: Words of a text as the contract of operator 7 has them; \\x escapes are RE2's.
FOLDED = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES: dict[str, str] = {
    "op7_benchmark_overlap": f"""
WITH d AS (SELECT doc_id, {FOLDED} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {FOLDED} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item, wide, array_to_string(w[s + 1:s + wide], ' ') AS words
    FROM (SELECT item, w, least(13, len(w)) AS wide, unnest(range(len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, s, wide, array_to_string(w[s + 1:s + wide], ' ') AS words
    FROM (SELECT doc_id, w, wide, unnest(range(len(w) - wide + 1)) AS s
          FROM d, (SELECT DISTINCT wide FROM iw) WHERE len(w) >= wide)
),
h AS (SELECT dw.doc_id, dw.s, dw.wide, iw.item FROM dw JOIN iw USING (wide, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + wide)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op8_jaccard_forest": f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {FOLDED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * k >= 4 * (x.n + y.n)
      UNION SELECT p.doc_id, q.doc_id FROM d p JOIN d q ON p.text = q.text AND p.doc_id <> q.doc_id WHERE len(p.w) = 0),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM d
""",
    "op12_rank_select_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, n, array_to_string(u[1:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS p,
             array_to_string(u[least(h[1] % (n + 1), h[2] % (n + 1)) + 1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS m,
             array_to_string(u[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1:], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                  WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM c
""",
    "op13_phrase_automata": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, 1000000::HUGEINT * x.a * x.a // (l.a::HUGEINT * r.a) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = x.head JOIN f AS r ON r.lang = x.lang AND r.phrase = x.tail),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
up AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY ALL),
ok AS (SELECT low.* FROM low LEFT JOIN up USING (lang, phrase) WHERE up.most IS NULL OR 100 * up.most < 50 * low.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ok QUALIFY rank <= 2000)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM t JOIN n USING (lang)
""",
    "op3_adaptive_rules": """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
                SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (
                    SELECT doc_id, i, array_to_string(w[i:i + 2], chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)))
            WHERE k > 1) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
        WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, unnest([{'k': 'symbols', 'v': n_symbols / greatest(n_words, 1)::DOUBLE, 'c': n_symbols, 'z': greatest(n_words, 1)},
                        {'k': 'dup_lines', 'v': n_dup_lines / greatest(n_lines, 1)::DOUBLE, 'c': n_dup_lines, 'z': greatest(n_lines, 1)},
                        {'k': 'repeats', 'v': n_repeat_words / greatest(n_words, 1)::DOUBLE, 'c': n_repeat_words, 'z': greatest(n_words, 1)},
                        {'k': 'word_length', 'v': word_chars / greatest(n_words, 1)::DOUBLE, 'c': word_chars, 'z': greatest(n_words, 1)}]) AS x FROM m),
b AS (SELECT *, CASE WHEN x.v < 1e-4 THEN 0 ELSE floor(ln(x.v / 1e-4) / ln(1.04::DOUBLE)) + 1 END AS bin FROM v
      WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
lev AS (SELECT 0 AS level, lang, source, x.k AS k, bin FROM b UNION ALL SELECT 1, lang, NULL, x.k, bin FROM b UNION ALL SELECT 2, NULL, NULL, x.k, bin FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, k ORDER BY bin) AS i, count(*) OVER (PARTITION BY level, lang, source, k) AS n FROM lev),
q AS (SELECT level, lang, source, k, n, [min(bin) FILTER (1000 * i >= 250 * n), min(bin) FILTER (1000 * i >= 750 * n), min(bin) FILTER (1000 * (i + 1) >= 800 * n), min(bin) FILTER (1000 * (i + 1) >= 999 * n)] AS qs
      FROM r GROUP BY level, lang, source, k, n),
w AS (SELECT level, lang, source, k, n, [1e-4 * pow(1.04::DOUBLE, a) FOR a IN qs] AS up, CASE WHEN qs[1] = 0 THEN 0 ELSE 1e-4 * pow(1.04::DOUBLE, qs[1] - 1) END AS low, qs[1] = qs[2] AS flat FROM q),
z AS (SELECT *, CASE WHEN flat THEN 0.0 ELSE 3.0 * (up[2] - low) END AS spread FROM w),
e AS (SELECT level, lang, source, k, n, greatest(up[2] + spread, CASE WHEN k IN ('dup_lines', 'repeats') THEN up[4] ELSE up[3] END, CASE WHEN k = 'word_length' THEN 0.0 ELSE 0.05 END) AS up,
             low - spread AS down FROM z),
u AS (SELECT o.lang, o.source, o.k, CASE WHEN o.n >= 30 THEN o.up WHEN l.n >= 30 THEN l.up ELSE a.up END AS up, CASE WHEN o.n >= 30 THEN o.down WHEN l.n >= 30 THEN l.down ELSE a.down END AS down
      FROM e o JOIN e l ON l.level = 1 AND l.k = o.k AND l.lang IS NOT DISTINCT FROM o.lang JOIN e a ON a.level = 2 AND a.k = o.k WHERE o.level = 0),
ok AS (SELECT v.doc_id, bool_and(x.c - u.up * x.z <= 3.0 * sqrt(u.up * x.z + 1) AND (x.k <> 'word_length' OR greatest(0.0, u.down * x.z) - x.c <= 3.0 * sqrt(greatest(0.0, u.down * x.z) + 1))) AS within
       FROM v JOIN u ON u.k = v.x.k AND u.lang IS NOT DISTINCT FROM v.lang AND u.source IS NOT DISTINCT FROM v.source GROUP BY v.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(within, FALSE) AS kept FROM m LEFT JOIN ok USING (doc_id)
""",
}
