"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each function returns one self-contained SQL string over the pre-registered
views (``documents``, ``benchmark``, ``pages``, ``embeddings``, ...). The
text expressions use the same patterns as ``palimpsest.functions.text``
(valid in both Java regex and RE2); lists are 1-based here.
"""

from __future__ import annotations

from html.entities import html5

from palimpsest.functions.text import (CLITICS, CONTRACTIONS, DIGIT_RUN, MINIMAL_STOPWORDS, NON_WORD_NON_SPACE,
                                       STRIP_EDGES, WS, WS_RUN)
from palimpsest.operators.abbreviations import CLOSING, OPENING, P_ABBREVIATION, THRESHOLD
from palimpsest.operators.stemming import STEP2_RULES, STEP3_RULES, STEP4_SUFFIXES
from palimpsest.sources.tables import REFERENCE_FORMAT, SOURCE_ID_FORMAT, SUSPICIOUS_ID_FORMAT


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# Markup and references as this oracle states them (RE2 has no possessive repetition and
# needs none; alternatives are tried in this order).
_MARKUP = "|".join((r"<!--(?:-?>|(?s:.)*?(?:--!?>|\z))", r"<script(?:[\s/][^>]*)?>(?s:.)*?(?:</script[^>]*>|\z)",
                    r"<style(?:[\s/][^>]*)?>(?s:.)*?(?:</style[^>]*>|\z)", r"<template(?:[\s/][^>]*)?>(?s:.)*?(?:</template[^>]*>|\z)",
                    r"<[!?][^>]*>", r"""</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>"""))
_REF = r"&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{0,31});"
_NAMED = {f"&{k}": v for k, v in html5.items() if k[-1] == ";" and k.islower()}


def strip_html_sql(t: str) -> str:
    t = f"regexp_replace({t}, {q(_MARKUP)}, '', 'g')"
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(_NAMED.items())) + "}"
    code = "CASE WHEN r[3] = 'x' THEN cast('0x' || r[4:-2] AS INT) ELSE cast(r[3:-2] AS INT) END"
    char = (f"list_transform([{code}], lambda c: CASE WHEN c = 0 OR c > 1114111 OR c BETWEEN 55296 AND 57343 "
            f"THEN chr(65533) ELSE chr(c) END)[1]")
    one = f"list_transform([s.r[i]], lambda r: CASE WHEN r IS NULL THEN '' WHEN r[2] = '#' THEN {char} ELSE coalesce({names}[r], r) END)[1]"
    return (f"list_transform([{t}], lambda x: CASE WHEN NOT regexp_matches(x, {q(_REF)}) THEN x ELSE "
            f"list_transform([{{'p': regexp_split_to_array(x, {q(_REF)}), 'r': regexp_extract_all(x, {q(_REF)})}}], "
            f"lambda s: array_to_string(list_transform(range(1, len(s.p) + 1), lambda i: s.p[i] || {one}), ''))[1] END)[1]")


def normalize_sql(t: str, html: bool = True) -> str:
    t = f"lower(coalesce({t}, ''))"
    if html:
        t = strip_html_sql(t)
    t = f"regexp_replace({t}, {q(NON_WORD_NON_SPACE)}, ' ', 'g')"
    return f"regexp_replace({t}, {q(DIGIT_RUN)}, ' ', 'g')"


def tokens_sql(t: str, html: bool = True) -> str:
    """C1 tokens (no stemming): normalise, split, drop empties and stop words."""
    stop = "[" + ", ".join(q(w) for w in MINIMAL_STOPWORDS) + "]"
    split = f"list_filter(regexp_split_to_array({normalize_sql(t, html)}, {q(WS_RUN)}), lambda x: x <> '')"
    return f"list_filter({split}, lambda x: NOT list_contains({stop}, x))"


def word_tokens_split_sql() -> str:
    """T5 with the word tokenizer's splits, a piece at a time."""
    word = r"[\p{L}\p{N}_]"
    piece = rf"{word}+(?:['.]{word}+)*|\.\.\.|--|[^\p{{L}}\p{{N}}_{WS}]"
    two = " ".join(f"WHEN {q(a + b)} THEN {q(a + ' ' + b)}" for a, b in CONTRACTIONS)
    clitic, apart = "'(" + "|".join(CLITICS) + ")$", r" '\1"
    not_ = "n't"
    split = (f"CASE WHEN list_contains([{', '.join(q(a + b) for a, b in CONTRACTIONS)}], p) THEN CASE p {two} END "
             f"WHEN length(p) > 3 AND suffix(p, {q(not_)}) THEN left(p, length(p) - 3) || ' ' || {q(not_)} "
             f"WHEN regexp_matches(p, {q('.' + clitic)}) THEN regexp_replace(p, {q(clitic)}, {q(apart)}) ELSE p END")
    pieces = f"regexp_extract_all(lower(coalesce(text, '')), {q(piece)})"
    return (f"SELECT doc_id, CASE tokens WHEN '' THEN 0 ELSE len(string_split(tokens, ' ')) END::BIGINT AS n_tokens, tokens FROM "
            f"(SELECT doc_id, array_to_string(list_transform({pieces}, lambda p: {split}), ' ') AS tokens FROM documents)")


def stem_ctes(words: str, out: str = "stems") -> str:
    """CTEs from ``words`` (a query of distinct ``tok``) to ``out(tok, stem)``: the 1980 Porter
    algorithm, a step a CTE, on the word ``w`` and its vowels and consonants ``s``."""
    m = lambda s: f"len(regexp_extract_all({s}, 'V+C'))"
    cut = lambda x, n: f"left({x}, length({x}) - ({n}))"
    double = "length(w) >= 2 AND right(w, 1) = left(right(w, 2), 1) AND suffix(s, 'C')"
    cvc = lambda w, s: f"(suffix({s}, 'CVC') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"

    def longest(suffixes):
        return "CASE " + " ".join(f"WHEN suffix(w, {q(f)}) THEN {q(f)}" for f in sorted(suffixes, key=len, reverse=True)) + " ELSE '' END"

    def rules(source, name, rules):
        new = "CASE f " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in rules) + " END"
        vowels = "regexp_replace(regexp_replace(r, '[^aeiou]', 'C', 'g'), '[aeiou]', 'V', 'g')"
        return f"""
{name}a AS (SELECT tok, w, s, {longest([a for a, _ in rules])} AS f FROM {source}),
{name}b AS (SELECT tok, w, s, f, f <> '' AND {m(cut('s', 'length(f)'))} > 0 AS x, {new} AS r FROM {name}a),
{name} AS (SELECT tok, CASE WHEN x THEN {cut('w', 'length(f)')} || r ELSE w END AS w,
       CASE WHEN x THEN {cut('s', 'length(f)')} || {vowels} ELSE s END AS s FROM {name}b)"""

    return f"""
p0 AS (SELECT tok, tok AS w, list_reduce(string_split(tok, ''), lambda a, c: a || CASE
         WHEN c = 'y' THEN CASE WHEN suffix(a, 'C') THEN 'V' ELSE 'C' END WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 'V' ELSE 'C' END, '') AS s
       FROM ({words})),
p1n AS (SELECT *, CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN 2 WHEN suffix(w, 'ss') THEN 0 WHEN suffix(w, 's') THEN 1 ELSE 0 END AS n FROM p0),
p1 AS (SELECT tok, {cut('w', 'n')} AS w, {cut('s', 'n')} AS s FROM p1n),
p2n AS (SELECT *, CASE WHEN suffix(w, 'eed') THEN CASE WHEN {m(cut('s', 3))} > 0 THEN 1 ELSE 0 END
         WHEN suffix(w, 'ed') AND contains({cut('s', 2)}, 'V') THEN 2 WHEN suffix(w, 'ing') AND contains({cut('s', 3)}, 'V') THEN 3 ELSE 0 END AS n FROM p1),
p2 AS (SELECT tok, {cut('w', 'n')} AS w, {cut('s', 'n')} AS s, n >= 2 AS x FROM p2n),
p3x AS (SELECT *, CASE WHEN NOT x THEN 0 WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN 1
         WHEN {double} AND right(w, 1) NOT IN ('l', 's', 'z') THEN -1 WHEN {m('s')} = 1 AND {cvc('w', 's')} THEN 1 ELSE 0 END AS e FROM p2),
p3 AS (SELECT tok, CASE e WHEN 1 THEN w || 'e' WHEN -1 THEN {cut('w', 1)} ELSE w END AS w,
         CASE e WHEN 1 THEN s || 'V' WHEN -1 THEN {cut('s', 1)} ELSE s END AS s FROM p3x),
p4x AS (SELECT *, suffix(w, 'y') AND contains({cut('s', 1)}, 'V') AS x FROM p3),
p4 AS (SELECT tok, CASE WHEN x THEN {cut('w', 1)} || 'i' ELSE w END AS w, CASE WHEN x THEN {cut('s', 1)} || 'V' ELSE s END AS s FROM p4x),
{rules('p4', 'p5', STEP2_RULES)},
{rules('p5', 'p6', STEP3_RULES)},
p7a AS (SELECT *, {longest(STEP4_SUFFIXES)} AS f FROM p6),
p7x AS (SELECT *, f <> '' AND {m(cut('s', 'length(f)'))} > 1 AND (f <> 'ion' OR right({cut('w', 3)}, 1) IN ('s', 't')) AS x FROM p7a),
p7 AS (SELECT tok, CASE WHEN x THEN {cut('w', 'length(f)')} ELSE w END AS w, CASE WHEN x THEN {cut('s', 'length(f)')} ELSE s END AS s FROM p7x),
p8x AS (SELECT *, suffix(w, 'e') AND ({m(cut('s', 1))} > 1 OR ({m(cut('s', 1))} = 1 AND NOT {cvc(cut('w', 1), cut('s', 1))})) AS x FROM p7),
p8 AS (SELECT tok, CASE WHEN x THEN {cut('w', 1)} ELSE w END AS w, CASE WHEN x THEN {cut('s', 1)} ELSE s END AS s FROM p8x),
{out} AS (SELECT tok, CASE WHEN length(tok) <= 2 THEN tok WHEN {m('s')} > 1 AND {double} AND suffix(w, 'l') THEN {cut('w', 1)} ELSE w END AS stem FROM p8)"""


def token_stems_sql() -> str:
    """Every distinct token of ``documents`` and its stem."""
    words = f"SELECT DISTINCT unnest({tokens_sql('text')}) AS tok FROM documents"
    return f"WITH {stem_ctes(words)}\nSELECT tok AS token, stem FROM stems"


def terms_sql(tok: str) -> str:
    """Unigrams + bigrams of the vectorizer tokens (length >= 2) in column ``tok``."""
    return (f"list_concat({tok}, list_transform(range(1, len({tok})), "
            f"lambda i: {tok}[i] || ' ' || {tok}[i + 1]))")


def strip_sql(s: str) -> str:
    return f"regexp_replace({s}, {q(STRIP_EDGES)}, '', 'g')"


def sentences_period_sql(t: str) -> str:
    pieces = f"string_split(translate(coalesce({t}, ''), '!?', '..'), '.')"
    kept = f"list_filter(list_transform({pieces}, lambda s: {strip_sql('s')}), lambda s: s <> '')"
    return f"list_transform({kept}, lambda s: s || '.')"


def sentences_newline_sql(t: str) -> str:
    broken = f"regexp_replace(coalesce({t}, ''), {q(f'([.!?])[{WS}]+')}, '\\1' || chr(10), 'g')"
    return (f"list_filter(list_transform(string_split({broken}, chr(10)), "
            f"lambda s: {strip_sql('s')}), lambda s: s <> '')")


def chunks_sql(sent: str, k: int, whole: str) -> str:
    """Windows of ``k`` sentences from list column ``sent``; whole-text fallback."""
    windows = (f"list_transform(range(0, cast(ceil(len({sent}) / {k}) AS BIGINT)), "
               f"lambda j: array_to_string({sent}[j * {k} + 1 : j * {k} + {k}], ' '))")
    return (f"CASE WHEN len({sent}) > 0 THEN {windows} "
            f"WHEN {strip_sql(whole)} <> '' THEN [{whole}] ELSE [] END")


def abbreviation_ctes() -> str:
    """CTEs ``tok`` (tokens of ``documents`` in place) and ``scored`` (words and their counts, score and kinds)."""
    opening, closing = q(OPENING)[1:-1], q(CLOSING)[1:-1]
    core = lambda t: f"regexp_replace({t}, '^{opening}+|{closing}+$', '', 'g')"
    return f"""
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {q(WS_RUN)}), lambda x: x <> '') AS t FROM documents),
tok AS (SELECT *, {core('t')} AS c, regexp_replace(lower({core('t')}), '\\.$', '') AS word,
               lag(t) OVER w AS before, lead(t) OVER w AS after
        FROM (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS pos FROM toks) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
counted AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE suffix(c, '.')) AS n_stop, count(*) FILTER (WHERE regexp_matches(c, '^\\p{{Ll}}')) AS n_lower,
                   count(*) FILTER (WHERE regexp_matches(c, '^\\p{{Lu}}') AND before IS NOT NULL
                                    AND NOT regexp_matches(before, '[.!?:;…]{closing}*$')) AS n_upper_inside
            FROM tok WHERE regexp_matches(word, '\\p{{L}}') GROUP BY word),
total AS (SELECT greatest(least(sum(n_stop) / sum(n), 1 - 1e-9), 1e-9) AS p FROM counted),
scored AS (SELECT *, score >= {THRESHOLD} AND n_stop > 0 AS is_abbreviation, n_lower > 0 AND n_upper_inside = 0 AS is_starter FROM (
  SELECT word, n, n_stop, n_lower, n_upper_inside,
         2 * (n_stop * ln({P_ABBREVIATION}) + (n - n_stop) * ln(1 - {P_ABBREVIATION}) - n_stop * ln(p) - (n - n_stop) * ln(1 - p))
           * exp(-l) * (length(word) - l + 1) * pow(l, n_stop - n) AS score
  FROM (SELECT *, length(replace(word, '.', ''))::DOUBLE AS l FROM counted), total))"""


def learned_chunks_sql(k: int = 5) -> str:
    """T12 + T13 over ``documents``."""
    opening, closing = q(OPENING)[1:-1], q(CLOSING)[1:-1]
    core = f"regexp_replace(after, '^{opening}+|{closing}+$', '', 'g')"
    return "WITH " + abbreviation_ctes() + f""",
marked AS (SELECT k.doc_id, k.pos, k.t,
    regexp_matches(k.c, '[!?]$') OR (suffix(k.c, '.') AND (NOT coalesce(a.is_abbreviation, false) OR
       (coalesce(s.is_starter, false) AND regexp_matches({core}, '^\\p{{Lu}}')))) AS ends
  FROM tok k LEFT JOIN scored a ON a.word = k.word LEFT JOIN scored s ON s.word = regexp_replace(lower({core}), '\\.$', '')),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM marked),
chunked AS (SELECT doc_id, (s // {k})::INT AS chunk_idx, string_agg(t, ' ' ORDER BY pos) AS chunk_text FROM numbered GROUP BY doc_id, s // {k})
SELECT doc_id, chunk_idx, chunk_text FROM chunked"""


def corpus_ctes(threshold: float = 0.3, stem: bool = False) -> str:
    """CTEs: src/sus docs, TF-IDF weights (IDF on sources), matched pairs,
    derived truth and truth-annotated matches ``matches``."""
    if stem:
        words = " UNION ".join(f"SELECT unnest({tokens_sql('text')}) AS tok FROM {t}" for t in ("documents", "benchmark"))
        side = lambda t: (f"(SELECT id, list(stem ORDER BY pos) FILTER (WHERE length(stem) >= 2) AS tok FROM (SELECT id, unnest(tok) AS tok, "  # noqa: E731
                          f"generate_subscripts(tok, 1) AS pos FROM (SELECT id, {tokens_sql('text')} AS tok FROM {t})) JOIN stems USING (tok) GROUP BY id)")
        tokens = f"{stem_ctes(words)},\nsrc_tok AS {side('src')},\nsus_tok AS {side('sus')},"
    else:
        tokens = f"""src_tok AS (SELECT id, list_filter({tokens_sql('text')}, lambda x: length(x) >= 2) AS tok FROM src),
sus_tok AS (SELECT id, list_filter({tokens_sql('text')}, lambda x: length(x) >= 2) AS tok FROM sus),"""
    return f"""
src AS (SELECT printf({q(SOURCE_ID_FORMAT)}, item_id) AS id, text FROM benchmark),
sus AS (SELECT printf({q(SUSPICIOUS_ID_FORMAT)}, doc_id) AS id, text FROM documents),
{tokens}
src_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms_sql('tok')}) AS term FROM src_tok) GROUP BY id, term),
sus_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms_sql('tok')}) AS term FROM sus_tok) GROUP BY id, term),
n_src AS (SELECT count(*) AS n FROM src),
idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM src_tf, n_src GROUP BY term, n),
src_w0 AS (SELECT id, term, tf * idf AS w FROM src_tf JOIN idf USING (term)),
sus_w0 AS (SELECT id, term, tf * idf AS w FROM sus_tf JOIN idf USING (term)),
src_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM src_w0),
sus_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM sus_w0),
pairs AS (SELECT a.id AS suspicious_id, b.id AS source_id, sum(a.w * b.w) AS sim
          FROM sus_w a JOIN src_w b USING (term) GROUP BY a.id, b.id
          HAVING sum(a.w * b.w) >= {threshold}),
truth AS (SELECT printf({q(SUSPICIOUS_ID_FORMAT)}, d.doc_id) AS suspicious_id,
                 printf({q(REFERENCE_FORMAT)}, b.item_id) AS source_reference,
                 instr(d.text, b.text) - 1 AS off, length(b.text) AS len, b.item_id
          FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
hits AS (SELECT p.suspicious_id, p.source_id,
                first(t.source_reference ORDER BY t.off, t.item_id) AS ref
         FROM pairs p JOIN truth t ON t.suspicious_id = p.suspicious_id
              AND contains(t.source_reference, p.source_id)
         GROUP BY p.suspicious_id, p.source_id),
matches AS (SELECT p.suspicious_id, p.source_id, p.sim AS similarity_score,
                   h.ref IS NOT NULL AS ground_truth, coalesce(h.ref, '') AS source_reference
            FROM pairs p LEFT JOIN hits h USING (suspicious_id, source_id))"""


def chunk_ctes(threshold: float = 0.3, k: int = 5, stem: bool = False) -> str:
    """CTEs for chunk mode over the truth pairs: ``matches`` (best source
    chunk per valid suspicious chunk, full texts) and ``summary`` per pair."""
    whole = "translate(coalesce(text, ''), '!?', '..')"

    def chunk_rows(table: str, key: str, ids: str) -> str:
        return f"""(SELECT {key} AS doc, unnest(range(0, len(ch)))::INT AS idx, unnest(ch) AS txt
  FROM (SELECT {key}, {chunks_sql('sent', k, whole)} AS ch
        FROM (SELECT {key}, text, {sentences_period_sql('text')} AS sent FROM {table}
              WHERE {key} IN (SELECT {ids} FROM pairs))))"""

    sides = (("sus", "documents", "doc_id"), ("src", "benchmark", "item_id"))
    suffix = "0" if stem else ""
    tokens = ",\n".join(f"{n}_c{suffix} AS (SELECT doc, idx, txt, {tokens_sql('txt')} AS all_tok FROM {chunk_rows(t, k_, k_)})" for n, t, k_ in sides) + ","
    if stem:
        words = " UNION ".join(f"SELECT unnest(all_tok) AS tok FROM {n}_c0" for n, _, _ in sides)
        tokens += stem_ctes(words) + ",\n" + ",\n".join(
            f"{n}_c AS (SELECT doc, idx, txt, coalesce(st, []) AS all_tok FROM {n}_c0 LEFT JOIN (SELECT doc, idx, list(stem ORDER BY pos) AS st FROM "
            f"(SELECT doc, idx, unnest(all_tok) AS tok, generate_subscripts(all_tok, 1) AS pos FROM {n}_c0) JOIN stems USING (tok) "
            f"GROUP BY doc, idx) USING (doc, idx))" for n, _, _ in sides) + ","
    return f"""
truth AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
pairs AS (SELECT DISTINCT printf({q(SUSPICIOUS_ID_FORMAT)}, doc_id) AS suspicious_id,
                 printf({q(SOURCE_ID_FORMAT)}, item_id) AS source_id, doc_id, item_id FROM truth),
{tokens}
units AS (SELECT p.suspicious_id, p.source_id, 'sus' AS side, c.idx,
                 list_filter(c.all_tok, lambda x: length(x) >= 2) AS tok
          FROM pairs p JOIN sus_c c ON c.doc = p.doc_id WHERE len(c.all_tok) > 0
          UNION ALL
          SELECT p.suspicious_id, p.source_id, 'src' AS side, c.idx,
                 list_filter(c.all_tok, lambda x: length(x) >= 2) AS tok
          FROM pairs p JOIN src_c c ON c.doc = p.item_id WHERE len(c.all_tok) > 0),
n AS (SELECT suspicious_id, source_id, count(*) AS n FROM units GROUP BY suspicious_id, source_id),
tf AS (SELECT suspicious_id, source_id, side, idx, term, count(*) AS tf
       FROM (SELECT suspicious_id, source_id, side, idx, unnest({terms_sql('tok')}) AS term FROM units)
       GROUP BY suspicious_id, source_id, side, idx, term),
idf AS (SELECT suspicious_id, source_id, term, ln((1 + n) / (1 + count(*))) + 1 AS idf
        FROM tf JOIN n USING (suspicious_id, source_id) GROUP BY suspicious_id, source_id, term, n),
w0 AS (SELECT suspicious_id, source_id, side, idx, term, tf * idf AS w
       FROM tf JOIN idf USING (suspicious_id, source_id, term)),
w AS (SELECT suspicious_id, source_id, side, idx, term,
             w / sqrt(sum(w * w) OVER (PARTITION BY suspicious_id, source_id, side, idx)) AS w FROM w0),
sims AS (SELECT a.suspicious_id, a.source_id, a.idx AS sus_idx, b.idx AS src_idx, sum(a.w * b.w) AS sim
         FROM w a JOIN w b ON a.suspicious_id = b.suspicious_id AND a.source_id = b.source_id
              AND a.term = b.term AND a.side = 'sus' AND b.side = 'src'
         GROUP BY a.suspicious_id, a.source_id, a.idx, b.idx),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suspicious_id, source_id, sus_idx
                                                   ORDER BY round(sim, 10) DESC, src_idx) AS rn FROM sims)
         WHERE rn = 1),
first_src AS (SELECT suspicious_id, source_id, min(idx) AS first_src FROM units WHERE side = 'src'
              GROUP BY suspicious_id, source_id),
bm AS (SELECT u.suspicious_id, u.source_id, u.idx AS suspicious_chunk_idx,
              coalesce(b.src_idx, f.first_src) AS source_chunk_idx, coalesce(b.sim, 0.0) AS similarity
       FROM units u JOIN first_src f USING (suspicious_id, source_id)
       LEFT JOIN best b ON b.suspicious_id = u.suspicious_id AND b.source_id = u.source_id AND b.sus_idx = u.idx
       WHERE u.side = 'sus'),
matches AS (SELECT bm.*, bm.similarity >= {threshold} AS is_flagged, s.txt AS suspicious_chunk_text,
                   r.txt AS source_chunk_text
            FROM bm JOIN pairs p USING (suspicious_id, source_id)
            JOIN sus_c s ON s.doc = p.doc_id AND s.idx = bm.suspicious_chunk_idx
            JOIN src_c r ON r.doc = p.item_id AND r.idx = bm.source_chunk_idx),
summary AS (SELECT p.suspicious_id, p.source_id,
                   coalesce(avg(m.similarity), 0.0) AS overall_similarity,
                   coalesce(max(m.similarity), 0.0) AS max_chunk_similarity,
                   count(*) FILTER (WHERE m.similarity >= {threshold})::BIGINT AS flagged_chunks,
                   count(m.similarity)::BIGINT AS compared_chunks
            FROM (SELECT DISTINCT suspicious_id, source_id FROM pairs) p
            LEFT JOIN bm m USING (suspicious_id, source_id)
            GROUP BY p.suspicious_id, p.source_id)"""


def metrics_sql() -> str:
    """C6 over the corpus-mode matches: precision, recall, F1 and counts."""
    return "WITH " + corpus_ctes() + """,
cases AS (SELECT DISTINCT suspicious_id, source_reference FROM truth),
hit_cases AS (SELECT DISTINCT suspicious_id, source_reference FROM matches WHERE ground_truth),
c AS (SELECT count(*) FILTER (WHERE ground_truth) AS tp, count(*) FILTER (WHERE NOT ground_truth) AS fp
      FROM matches),
k AS (SELECT count(*) AS n_case, count(*) FILTER (WHERE h.suspicious_id IS NULL) AS missed
      FROM cases LEFT JOIN hit_cases h USING (suspicious_id, source_reference)),
s AS (SELECT tp, fp, n_case - tp AS fn, missed FROM c, k),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM s)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall,
       round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1_score,
       tp::BIGINT AS true_positives, fp::BIGINT AS false_positives, fn::BIGINT AS false_negatives,
       missed::BIGINT AS false_negatives_strict FROM p"""


def corpus_counts_sql() -> str:
    return "WITH " + corpus_ctes() + """
SELECT ((SELECT count(*) FROM src) + (SELECT count(*) FROM sus))::BIGINT AS documents,
       (SELECT count(*) FROM src)::BIGINT AS source_documents,
       (SELECT count(*) FROM sus)::BIGINT AS suspicious_documents,
       (SELECT count(*) FROM matches)::BIGINT AS matches,
       (SELECT count(*) FILTER (WHERE ground_truth) FROM matches)::BIGINT AS confirmed_matches"""


def truth_sql() -> str:
    return "WITH " + corpus_ctes() + """
SELECT suspicious_id,
       (row_number() OVER (PARTITION BY suspicious_id ORDER BY off, item_id) - 1)::INT AS ordinal,
       source_reference, off::INT AS "offset", len::INT AS "length", 'unknown' AS "type",
       'none' AS obfuscation
FROM truth"""


def dense_ctes(threshold: float = 0.8) -> str:
    """Nearest other vector with the same label (ties to the lower id)."""
    return f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
             sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv
      FROM embeddings),
s AS (SELECT a.label, a.vec_id AS sus, b.vec_id AS src,
             CASE WHEN a.nv > 0 AND b.nv > 0 THEN list_dot_product(a.v, b.v) / (a.nv * b.nv) ELSE 0.0 END AS sim
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
best AS (SELECT label, sus, src, sim FROM (
           SELECT *, row_number() OVER (PARTITION BY label, sus ORDER BY round(sim, 10) DESC, src) AS rn FROM s)
         WHERE rn = 1)"""


def dense_text_ctes(threshold: float = 0.8, dim: int = 256) -> str:
    """CTEs for dense mode over the truth pairs with the built-in hashing
    embedder: ``best`` (top-1 source chunk per suspicious chunk) and chunk
    texts ``sus_c`` / ``src_c``. Every (suspicious, source) chunk pair of a
    pair is scored (cosine 0 when no bucket is shared), as argmax needs."""
    word = r"[\p{L}\p{N}_]+"

    def chunk_rows(table: str, key: str) -> str:
        return f"""(SELECT doc, idx, txt FROM (
  SELECT {key} AS doc, unnest(range(0, len(ch)))::BIGINT AS idx, unnest(ch) AS txt
  FROM (SELECT {key}, {chunks_sql('sent', 1, 'text')} AS ch
        FROM (SELECT {key}, text, {sentences_newline_sql('text')} AS sent FROM {table}
              WHERE {key} IN (SELECT {key} FROM pairs))))
  WHERE {strip_sql('txt')} <> '')"""

    def vectors(chunks: str) -> str:
        return f"""(SELECT doc, idx, bucket, sum(sign) AS v FROM (
  SELECT doc, idx, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS bucket,
         CASE WHEN ('0x' || substr(md5(tok), 9, 8))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign
  FROM (SELECT doc, idx, unnest(regexp_extract_all(lower(txt), {q(word)})) AS tok FROM {chunks}))
  GROUP BY doc, idx, bucket)"""

    def norms(chunks: str, vecs: str) -> str:
        return f"""(SELECT c.doc, c.idx, coalesce(sqrt(sum(v.v * v.v)), 0.0) AS nv
  FROM {chunks} c LEFT JOIN {vecs} v ON v.doc = c.doc AND v.idx = c.idx GROUP BY c.doc, c.idx)"""

    return f"""
truth AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
pairs AS (SELECT DISTINCT printf({q(SUSPICIOUS_ID_FORMAT)}, doc_id) AS suspicious_id,
                 printf({q(SOURCE_ID_FORMAT)}, item_id) AS source_id, doc_id, item_id FROM truth),
sus_c AS {chunk_rows('documents', 'doc_id')},
src_c AS {chunk_rows('benchmark', 'item_id')},
sus_v AS {vectors('sus_c')},
src_v AS {vectors('src_c')},
sus_n AS {norms('sus_c', 'sus_v')},
src_n AS {norms('src_c', 'src_v')},
allpairs AS (SELECT p.suspicious_id, p.source_id, p.doc_id, p.item_id, a.idx AS sus_idx, b.idx AS src_idx,
                    a.nv AS na, b.nv AS nb
             FROM pairs p JOIN sus_n a ON a.doc = p.doc_id JOIN src_n b ON b.doc = p.item_id),
dots AS (SELECT p.suspicious_id, p.source_id, p.sus_idx, p.src_idx, sum(x.v * y.v) AS dot
         FROM allpairs p JOIN sus_v x ON x.doc = p.doc_id AND x.idx = p.sus_idx
         JOIN src_v y ON y.doc = p.item_id AND y.idx = p.src_idx AND y.bucket = x.bucket
         GROUP BY p.suspicious_id, p.source_id, p.sus_idx, p.src_idx),
sims AS (SELECT a.*, CASE WHEN a.na > 0 AND a.nb > 0 THEN coalesce(d.dot, 0.0) / (a.na * a.nb)
                          ELSE 0.0 END AS sim
         FROM allpairs a LEFT JOIN dots d USING (suspicious_id, source_id, sus_idx, src_idx)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suspicious_id, source_id, sus_idx
                                                   ORDER BY round(sim, 10) DESC, src_idx) AS rn FROM sims)
         WHERE rn = 1)"""
