"""SQL for DuckDB that computes the same results relationally: long tables where the engine has projections.

Each query is a chain of the common table expressions that it needs.
"""

from __future__ import annotations

from ..functions import charsets as c
from ..operators import labels
from ..sources.lexicon import seed_rows
from . import fixtures


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)


def _class(s: str, body: str) -> str:
    return f"(length({s}) - length(regexp_replace({s}, '[{body}]', '', 'g')))"


def _set(s: str, letters: str) -> str:
    return f"(length({s}) - length(translate({s}, '{letters}', '')))"


def _word(s: str, word: str) -> str:
    return f"((length({s}) - length(replace({s}, '{word}', ''))) // {len(word)})"


def _f(x) -> str:
    return f"CAST({x} AS FLOAT)"


def _ratio(a: str, b: str) -> str:
    return f"CAST(CAST({_f(a)} AS DOUBLE) / nullif(CAST({_f(b)} AS DOUBLE), 0) AS FLOAT)"


def _round2(x: str) -> str:
    return f"CAST(CAST(round({x} * CAST(100 AS FLOAT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS FLOAT)"


def _sum(x: str, order: str) -> str:
    """A sum in single precision, in order."""
    return f"list_reduce(list({x} ORDER BY {order}), lambda a, b: a + b)"


def _macro(t: str) -> str:
    return f"CASE WHEN {t} IN ({', '.join(map(_text, c.SINITIC))}) THEN 'zh' ELSE {t} END"


def _strings(xs) -> str:
    return ", ".join(map(_text, xs))


_LATIN_TAGS, _CJK_TAGS = _strings(c.LATIN_TAGS), _strings(c.CJK_WORD_TAGS)
_HANT_FLAVOUR = "CASE WHEN hk > 0 AND tw = 0 THEN 'zh-Hant-HK' WHEN tw > 0 AND hk = 0 THEN 'zh-Hant-TW' ELSE 'zh-Hant' END"


def _capped(n: str, rule) -> str:
    return f"least({_f(rule[0])} * {_f(n)}, {_f(rule[1])})"


_SENTENCE_LANGUAGE = f"""CASE WHEN regexp_matches(sentence, '[{c.KANA}]') THEN 'ja' WHEN regexp_matches(sentence, '[{c.HANGUL}]') THEN 'ko'
  WHEN regexp_matches(sentence, '[{c.HAN}]') AND NOT regexp_matches(sentence, '[{c.LATIN}]') THEN
    CASE WHEN {_set('sentence', c.HANS_ONLY)} > 0 AND {_set('sentence', c.HANT_SENTENCE)} = 0 THEN 'zh-Hans'
         WHEN {_set('sentence', c.HANT_SENTENCE)} > 0 AND {_set('sentence', c.HANS_ONLY)} = 0 THEN 'zh-Hant' ELSE 'zh' END
  WHEN regexp_matches(sentence, '[{c.LATIN}]') THEN
    CASE WHEN {_class('sentence', c.VI_MARKERS)} > 0 AND {_ratio(_class('sentence', c.VI_MARKERS), _class('sentence', c.LATIN))} >= {_f(0.05)} THEN 'vi' ELSE 'en' END END"""

_DOC_TEXTS = f"SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values(fixtures.rows())}) f(doc_id, text)"
_ML_TEXTS = f"SELECT * FROM (VALUES {_values((i, t) for i, (t, _, _) in enumerate(fixtures.SCORES))}) f(doc_id, text)"
_ML_SCORES = f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(ord AS BIGINT) AS ord, tag, CAST(conf AS FLOAT) AS conf FROM (VALUES {_values((i, o, t, p) for i, (_, s, _) in enumerate(fixtures.SCORES) for o, (t, p) in enumerate(s))}) f(doc_id, ord, tag, conf)"
_ML_SIGNALS = f"SELECT * FROM (VALUES {_values((i, *u) for i, (_, _, u) in enumerate(fixtures.SCORES) if u)}) f(doc_id, label, conf)"

_PARTS = {
    "input": _DOC_TEXTS,
    "norm": f"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[{c.CONTROL}]', '', 'g'), '[{c.SPACE}]+', ' ', 'g'), ' ') AS norm FROM input",
    "counts": f"""SELECT *, latin + kana + han + hangul AS total, length(replace(norm, ' ', '')) - latin - kana - han - hangul AS other FROM (
      SELECT *, hiragana + katakana AS kana FROM (
        SELECT doc_id, norm, length(regexp_replace(norm, '[{c.PUNCTUATION}]', '', 'g')) AS visible, {_class('norm', c.LATIN)} AS latin, {_class('norm', c.HIRAGANA)} AS hiragana,
          {_class('norm', c.KATAKANA)} AS katakana, {_class('norm', c.HAN)} AS han, {_class('norm', c.HANGUL)} AS hangul, {_class('norm', c.VI_MARKERS)} AS vi, {_set('norm', c.FR_MARKERS)} AS fr,
          {', '.join(f"{_set('norm', v)} AS {k}" for k, v in c.MARKERS.items())} FROM norm))""",
    "lex": f"SELECT * FROM (VALUES {_values(seed_rows())}) l(lang, rank, word)",
    "top": f"SELECT DISTINCT lang, word FROM lex WHERE rank <= {c.TOP_WORDS} AND lang IN ('en', 'fr', 'vi', 'ja', 'zh-Hans', 'zh-Hant', 'ko') UNION SELECT * FROM (VALUES {_values([('yue', w) for w in c.YUE_WORDS] + [('lzh', w) for w in c.LZH_WORDS])}) w(lang, word)",
    "latin_tokens": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(norm, '[{c.LATIN}]+')) AS token FROM norm) GROUP BY ALL",
    "cjk_only": f"SELECT doc_id, regexp_replace(norm, '[^{c.CJK}]', '', 'g') AS s FROM norm WHERE regexp_matches(norm, '[{c.CJK}]')",
    "cjk_tokens": "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, substr(s, i, w) AS token FROM cjk_only, (VALUES (2), (3), (4)) z(w), unnest(range(1, length(s) + 1)) r(i) WHERE i + w - 1 <= length(s)) GROUP BY ALL",
    "cjk_grams": f"SELECT doc_id, substr(s, i, w) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(norm, '[{c.CJK}]+')) AS s FROM norm) b, (VALUES (1), (2)) z(w), unnest(range(1, length(s) + 1)) r(i) WHERE i + w - 1 <= length(s)",
    "fw": f"""SELECT doc_id, lang, CAST(sum(n) AS BIGINT) AS hits FROM (
      SELECT doc_id, lang, n FROM latin_tokens JOIN top ON lower(token) = word WHERE lang IN ({_LATIN_TAGS})
      UNION ALL SELECT doc_id, lang, 1 FROM cjk_grams JOIN top ON token = word WHERE lang IN ({_CJK_TAGS})) GROUP BY ALL""",
    "probed": f"""SELECT doc_id, token, lang, count(*) OVER (PARTITION BY doc_id, token) AS k FROM (SELECT doc_id, token FROM latin_tokens UNION SELECT doc_id, token FROM cjk_tokens)
      JOIN (SELECT DISTINCT lang, word FROM lex) x ON CASE WHEN lang IN ({_LATIN_TAGS}) THEN lower(token) ELSE token END = word""",
    "dict": "SELECT doc_id, lang, count(*) AS hits, count(*) FILTER (k = 1) AS exclusive, count(*) FILTER (k > 1) AS shared FROM probed GROUP BY ALL",
    "dict_totals": "SELECT doc_id, count(DISTINCT token) AS recognized, count(DISTINCT token) FILTER (k > 1) AS ambiguous FROM probed GROUP BY ALL",
    "flags": "SELECT word, bool_or(lang = 'en') AS en, bool_or(lang = 'fr') AS fr, bool_or(lang = 'vi') AS vi FROM lex GROUP BY ALL",
    "token_lang": f"""SELECT token, CASE WHEN regexp_matches(token, '[{c.VI_MARKERS}]') THEN 'vi' WHEN regexp_matches(token, '[{c.FR_MARKERS}]') THEN 'fr'
        WHEN en AND fr THEN CASE WHEN lower(token) IN (SELECT word FROM top WHERE lang = 'fr') AND lower(token) NOT IN (SELECT word FROM top WHERE lang = 'en') THEN 'fr' ELSE 'en' END
        WHEN en AND vi THEN CASE WHEN regexp_matches(lower(token), '{c.VI_SHAPE[0]}') AND regexp_matches(lower(token), '{c.VI_SHAPE[1]}') THEN 'vi' ELSE 'en' END
        WHEN fr THEN 'fr' WHEN en THEN 'en' WHEN vi THEN 'vi' END AS lang FROM (SELECT DISTINCT token FROM latin_tokens) LEFT JOIN flags ON lower(token) = word""",
    "attr": "SELECT doc_id, lang, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n * length(token)) AS BIGINT) AS n_chars FROM latin_tokens JOIN token_lang USING (token) WHERE lang IS NOT NULL GROUP BY ALL",
    "grams": f"""SELECT doc_id, CAST({' + '.join(_word('s', g) for g in c.EN_NGRAMS)} AS BIGINT) AS en_hits, CAST({' + '.join(_word('s', g) for g in c.VI_NGRAMS)} AS BIGINT) AS vi_hits
      FROM (SELECT doc_id, lower(regexp_replace(norm, '[^{c.LATIN} ]', '', 'g')) AS s FROM norm)""",
    "ends": f"SELECT doc_id, {', '.join(f'CAST({' + '.join(_word('norm', w) for w in ws)} AS BIGINT) AS {k}' for k, ws in c.ENDINGS.items())} FROM norm",
    "sents": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS ord, sentence FROM (
      SELECT doc_id, raw, ltrim(piece, ' ') AS sentence FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS raw FROM (SELECT doc_id, regexp_extract_all(norm, '{c.SENTENCE}') AS pieces FROM norm)))
      WHERE sentence <> '' QUALIFY ord < {c.SENTENCES}""",
    "sent_lang": f"SELECT doc_id, ord, sentence, {_SENTENCE_LANGUAGE} AS language FROM sents",
    "ctx": f"""SELECT doc_id, {', '.join(f"count(*) FILTER (language = '{t}') AS {'ctx_' + t.replace('-', '_').lower()}" for t in ('en', 'ja', 'ko', 'vi', 'zh', 'zh-Hans', 'zh-Hant'))},
        count(language) AS ctx_sentences, CAST(coalesce(sum(len(regexp_extract_all(sentence, '[{c.HAN}]{{5,}}'))) FILTER (language NOT LIKE 'zh%'), 0) AS BIGINT) AS embedded_han_runs FROM sent_lang GROUP BY doc_id""",
    "context": """SELECT n.doc_id, coalesce(ctx_en, 0) AS ctx_en, coalesce(ctx_ja, 0) AS ctx_ja, coalesce(ctx_ko, 0) AS ctx_ko, coalesce(ctx_vi, 0) AS ctx_vi, coalesce(ctx_zh, 0) AS ctx_zh, coalesce(ctx_zh_hans, 0) AS ctx_zh_hans,
        coalesce(ctx_zh_hant, 0) AS ctx_zh_hant, coalesce(embedded_han_runs, 0) AS embedded_han_runs, coalesce(ctx_sentences, 0) AS ctx_sentences, coalesce(embedded_han_runs, 0) >= 2 OR coalesce(m.second >= 1 AND m.second * 5 >= m.first, false) AS multi_language
      FROM norm n LEFT JOIN ctx USING (doc_id) LEFT JOIN (SELECT doc_id, max(n) AS first, max(n) FILTER (r = 2) AS second FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM (SELECT doc_id, split_part(language, '-', 1) AS macro, count(*) AS n FROM sent_lang WHERE language IS NOT NULL GROUP BY ALL)) GROUP BY doc_id) m USING (doc_id)""",
    "strategies": f"""SELECT *, CASE WHEN lzh >= 3 AND han >= 4 THEN 'lzh' WHEN yue > 0 THEN 'yue' WHEN hans > kana AND hant = 0 THEN 'zh-Hans' WHEN hant > kana AND hans = 0 THEN {_HANT_FLAVOUR}
        WHEN kana > 0 THEN 'ja' WHEN hans > 0 AND hant = 0 THEN 'zh-Hans' WHEN hant > 0 AND hans = 0 THEN {_HANT_FLAVOUR} ELSE 'zh' END AS strategy FROM counts""",
    "wide": f"""SELECT s.*, {_HANT_FLAVOUR} AS hant_tag, coalesce(a.en, 0) AS chars_en, coalesce(a.fr, 0) AS chars_fr, coalesce(a.vi, 0) AS chars_vi, coalesce(a.n, 0) AS attributed, g.en_hits, g.vi_hits,
        kana + hans + hant + nan + hak + wuu AS proof, lzh >= 3 AND han >= 4 AS classical
      FROM strategies s JOIN grams g USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n_chars) FILTER (lang = 'en') AS en, sum(n_chars) FILTER (lang = 'fr') AS fr, sum(n_chars) FILTER (lang = 'vi') AS vi, sum(n_tokens) AS n FROM attr GROUP BY doc_id) a USING (doc_id)
      WHERE visible > 0 AND total > 0""",
    "plain": f"""SELECT doc_id, unnest(CASE
        WHEN latin = 0 THEN CAST([] AS STRUCT(tag VARCHAR, w FLOAT)[])
        WHEN attributed > 0 THEN CASE WHEN latin > chars_en + chars_fr + chars_vi THEN [{{'tag': CASE WHEN vi >= 1 AND {_ratio('vi', 'latin')} >= {_f('0.10')} THEN 'vi' WHEN fr >= 1 AND chars_fr > 0 THEN 'fr' ELSE 'en' END, 'w': {_ratio('latin - chars_en - chars_fr - chars_vi', 'total')}}}] ELSE [] END
        WHEN {_ratio('vi', 'latin')} >= {_f('0.10')} THEN [{{'tag': 'vi', 'w': {_ratio('latin', 'total')}}}]
        WHEN {_ratio('fr', 'latin')} >= {_f('0.05')} THEN [{{'tag': 'fr', 'w': {_ratio('latin', 'total')}}}]
        WHEN vi >= 1 THEN [{{'tag': 'vi', 'w': least({_ratio('vi', 'total')}, {_ratio('latin', 'total')})}}, {{'tag': 'en', 'w': {_ratio('latin', 'total')} - least({_ratio('vi', 'total')}, {_ratio('latin', 'total')})}}]
        WHEN fr >= 1 THEN [{{'tag': 'fr', 'w': least({_ratio('fr', 'total')}, {_ratio('latin', 'total')})}}, {{'tag': 'en', 'w': {_ratio('latin', 'total')} - least({_ratio('fr', 'total')}, {_ratio('latin', 'total')})}}]
        WHEN vi_hits > 3 * en_hits THEN [{{'tag': 'vi', 'w': {_ratio('latin', 'total')}}}]
        ELSE [{{'tag': 'en', 'w': {_ratio('latin', 'total')}}}] END) AS e FROM wide""",
    "han_split": f"""SELECT doc_id, unnest(CASE WHEN han = 0 THEN CAST([] AS STRUCT(tag VARCHAR, w FLOAT)[])
        WHEN classical THEN [{{'tag': 'lzh', 'w': {_ratio('han', 'total')}}}] WHEN yue > 0 THEN [{{'tag': 'yue', 'w': {_ratio('han', 'total')}}}]
        WHEN proof > 0 THEN [{', '.join(f"{{'tag': {t}, 'w': {_ratio('han', 'total')} * {_ratio(k, 'proof')}}}" for t, k in (("'ja'", 'kana'), ("'zh-Hans'", 'hans'), ('hant_tag', 'hant'), ("'nan'", 'nan'), ("'hak'", 'hak'), ("'wuu'", 'wuu')))}]
        ELSE [{{'tag': 'ja', 'w': {_ratio('han', 'total')} * {_f('0.50')}}}, {{'tag': 'zh-Hans', 'w': {_ratio('han', 'total')} * {_f('0.25')}}}, {{'tag': hant_tag, 'w': {_ratio('han', 'total')} * {_f('0.25')}}}] END) AS e FROM wide""",
    "contrib": f"""SELECT doc_id, 0 AS ord, 'ko' AS tag, {_ratio('hangul', 'total')} AS w FROM wide
      UNION ALL SELECT doc_id, 1, lang, {_ratio('n_chars', 'total')} FROM attr JOIN wide USING (doc_id)
      UNION ALL SELECT doc_id, 2, e.tag, e.w FROM plain UNION ALL SELECT doc_id, 3, 'ja', {_ratio('kana', 'total')} FROM wide UNION ALL SELECT doc_id, 4, e.tag, e.w FROM han_split
      UNION ALL SELECT doc_id, 5, lang, {_capped('hits', c.FUNCTION_WORD)} FROM fw
      UNION ALL SELECT doc_id, 6, lang, {_capped('exclusive', c.EXCLUSIVE)} FROM dict UNION ALL SELECT doc_id, 7, lang, {_capped('shared', c.SHARED)} FROM dict
      UNION ALL SELECT doc_id, 8, lang, {_capped('n_tokens', c.MORPHOLOGY)} FROM attr
      {' '.join(f"UNION ALL SELECT doc_id, 8, '{k}', {_capped(k, c.MORPHOLOGY)} FROM ends" for k in c.ENDINGS)}
      UNION ALL SELECT doc_id, 9, language, {_capped('count(*)', c.CONTEXT)} FROM sent_lang WHERE language IS NOT NULL GROUP BY doc_id, language""",
    "weights": f"SELECT doc_id, tag, {_sum('w', 'ord')} AS w FROM contrib WHERE doc_id IN (SELECT doc_id FROM wide) AND w > 0 GROUP BY doc_id, tag",
    "totals": f"SELECT doc_id, {_sum('w', 'tag')} AS sum FROM weights GROUP BY doc_id",
    "fine": f"SELECT doc_id, tag, {_round2('share')} AS confidence FROM (SELECT doc_id, tag, {_ratio('w', 'sum')} AS share FROM weights JOIN totals USING (doc_id)) WHERE share > 0",
    "macros": f"SELECT doc_id, macro AS language, {_round2('s')} AS confidence FROM (SELECT doc_id, {_macro('tag')} AS macro, {_sum('confidence', 'confidence DESC, tag')} AS s FROM fine GROUP BY doc_id, macro)",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, language) AS r FROM macros",
    "tops": f"""SELECT doc_id, min(language) FILTER (r = 1) AS top_macro, max(confidence) FILTER (r = 1 AND confidence >= {_f(c.KEEP_FLOOR)}) AS first, max(confidence) FILTER (r = 2 AND confidence >= {_f(c.KEEP_FLOOR)}) AS second,
        count(*) FILTER (confidence >= {_f(c.KEEP_FLOOR)}) AS kept, count(*) FILTER (confidence >= {_f(c.MIXED_FLOOR)}) AS strong FROM ranked GROUP BY doc_id""",
    "variant": f"SELECT doc_id, max(tag) AS primary_variant FROM (SELECT f.*, max(confidence) OVER (PARTITION BY f.doc_id) AS best FROM fine f JOIN tops t ON f.doc_id = t.doc_id AND {_macro('f.tag')} = t.top_macro) WHERE confidence = best GROUP BY doc_id",
    "signals": "SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS FLOAT) AS conf WHERE false",
    "state": f"""SELECT c.doc_id, c.norm, v.primary_variant AS variant, t.*, x.multi_language, g.label, g.conf AS label_conf, CASE
          WHEN visible = 0 THEN 'empty' WHEN g.conf >= {_f(c.ML_UNSUPPORTED)} THEN 'refused' WHEN c.total = 0 AND c.other > 0 THEN 'foreign' WHEN t.doc_id IS NULL THEN 'none' WHEN kept = 0 THEN 'floor'
          WHEN (first >= {_f(c.DOMINANT)} OR first - coalesce(second, {_f(0)}) >= {_f('0.30')}) THEN CASE WHEN x.multi_language THEN 'downgraded' ELSE 'resolved' END
          WHEN strong >= 2 AND first < {_f('0.70')} AND visible >= {c.MIXED_VISIBLE} THEN 'mixed' ELSE 'ambiguous' END AS state
        FROM counts c LEFT JOIN tops t USING (doc_id) LEFT JOIN variant v USING (doc_id) LEFT JOIN context x USING (doc_id) LEFT JOIN signals g USING (doc_id)""",
    "verdict": f"""SELECT doc_id, CASE WHEN state IN ('empty', 'none', 'floor') THEN 'unknown' WHEN state IN ('refused', 'foreign') THEN 'unsupported' WHEN state = 'downgraded' THEN 'ambiguous' ELSE state END AS status,
        CASE WHEN state IN ('resolved', 'downgraded', 'mixed', 'ambiguous') THEN top_macro END AS primary_language, CASE WHEN state NOT IN ('empty', 'refused', 'foreign') THEN variant END AS primary_variant,
        CASE WHEN state IN ('resolved', 'downgraded', 'mixed', 'ambiguous') THEN kept ELSE 0 END AS n_candidates, CASE WHEN state IN ('resolved', 'downgraded', 'mixed', 'ambiguous') THEN round(CAST(first AS DOUBLE), 2) END AS top_confidence, norm, state,
        CASE state WHEN 'empty' THEN {_text(c.EMPTY_NOTE)} WHEN 'foreign' THEN {_text(c.FOREIGN_NOTE)}
          WHEN 'refused' THEN {_text(c.ML_REFUSED[0])} || label || {_text(c.ML_REFUSED[1])} || printf('%.2f', label_conf) || {_text(c.ML_REFUSED[2])}
          WHEN 'none' THEN {_text(c.NO_SCRIPT_NOTE)} WHEN 'floor' THEN {_text(c.FLOOR_NOTE)}
          WHEN 'downgraded' THEN top_macro || {_text(c.PRIMARY_NOTE)} || printf('%.2f', first) || {_text(c.DOWNGRADED_NOTE)}
          WHEN 'resolved' THEN CASE WHEN first >= {_f(c.DOMINANT)} AND second IS NULL THEN {_text(c.SINGLE_NOTE)} || top_macro ELSE top_macro || {_text(c.PRIMARY_NOTE)} || printf('%.2f', first) || {_text(c.EMBEDDED_NOTE)} END
          WHEN 'mixed' THEN strong || {_text(c.MIXED_NOTE)}
          ELSE {_text(c.AMBIGUOUS_NOTE[0])} || printf('%.2f', first - coalesce(second, {_f(0)})) || {_text(c.AMBIGUOUS_NOTE[1])} END AS note
      FROM state""",
    "listed": """SELECT doc_id, string_agg(p, ', ' ORDER BY p) FILTER (kind = 'fw') AS words, string_agg(p, ', ' ORDER BY p) FILTER (kind = 'shape') AS shapes, string_agg(p, ', ' ORDER BY p) FILTER (kind = 'ctx') AS around FROM (
        SELECT doc_id, 'fw' AS kind, lang || ':' || hits AS p FROM fw UNION ALL SELECT doc_id, 'shape', lang || ':' || n_tokens FROM attr
        UNION ALL SELECT doc_id, 'shape', k || ':' || n FROM (UNPIVOT ends ON ja, ko, zh INTO NAME k VALUE n) WHERE n > 0
        UNION ALL SELECT doc_id, 'ctx', language || ':' || count(*) FROM sent_lang WHERE language IS NOT NULL GROUP BY doc_id, language) GROUP BY doc_id""",
    "scores": "SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS note WHERE false",
    "told": f"""SELECT v.doc_id, CASE WHEN state IN ('empty', 'refused', 'foreign') THEN v.note ELSE concat_ws(' | ',
        {_text(c.SCRIPT_NOTE + 'latin:')} || latin || ', hiragana:' || hiragana || ', katakana:' || katakana || ', han:' || han || ', hangul:' || hangul,
        {', '.join(f"CASE WHEN {k} > 0 THEN '{label}' || {k} END" for k, label in ((k, c.MARKER_NOTES[k]) for k in ('vi', 'fr', 'hans', 'hant', 'yue')))},
        CASE WHEN lzh > 0 AND han >= 4 THEN {_text(c.CLASSICAL_NOTE[0])} || lzh || {_text(c.CLASSICAL_NOTE[1])} || han || {_text(c.CLASSICAL_NOTE[2])} END,
        {', '.join(f"CASE WHEN {k} > 0 THEN '{label}' || {k} END" for k, label in ((k, c.MARKER_NOTES[k]) for k in ('hk', 'tw', 'nan', 'hak', 'wuu')))},
        CASE WHEN kana > 0 THEN CASE WHEN hans > kana OR hant > kana THEN {_text(c.KANA_NOTES[0])}
          WHEN hans > 0 OR hant > 0 THEN {_text(c.KANA_NOTES[1])} ELSE {_text(c.KANA_NOTES[2])} END END,
        {_text(c.WORDS_NOTE)} || words, CASE WHEN recognized > 0 THEN {_text(c.DICTIONARY_NOTE[0])} || recognized || {_text(c.DICTIONARY_NOTE[1])} || ambiguous || {_text(c.DICTIONARY_NOTE[2])} END,
        {_text(c.MORPHOLOGY_NOTE[0])} || shapes || CASE WHEN a.n > 0 THEN {_text(c.MORPHOLOGY_NOTE[1])} || a.n || {_text(c.MORPHOLOGY_NOTE[2])} ELSE '' END,
        CASE WHEN ctx_sentences > 0 THEN {_text(c.CONTEXT_NOTE[0])} || ctx_sentences || {_text(c.CONTEXT_NOTE[1])} || around || {_text(c.CONTEXT_NOTE[2])} || CASE WHEN x.multi_language THEN {_text(c.CONTEXT_NOTE[3])} ELSE '' END END, s.note, v.note) END AS reasons
      FROM verdict v JOIN counts c USING (doc_id) LEFT JOIN listed l USING (doc_id) LEFT JOIN dict_totals d USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(n_tokens) AS BIGINT) AS n FROM attr GROUP BY doc_id) a USING (doc_id) LEFT JOIN context x USING (doc_id) LEFT JOIN scores s USING (doc_id)""",
}
_NEEDS = {
    "norm": ["input"], "counts": ["norm"], "top": ["lex"], "latin_tokens": ["norm"], "cjk_only": ["norm"], "cjk_tokens": ["cjk_only"], "cjk_grams": ["norm"], "fw": ["latin_tokens", "cjk_grams", "top"],
    "probed": ["latin_tokens", "cjk_tokens", "lex"], "dict": ["probed"], "dict_totals": ["probed"], "flags": ["lex"], "token_lang": ["latin_tokens", "flags", "top"], "attr": ["latin_tokens", "token_lang"], "grams": ["norm"], "ends": ["norm"],
    "sents": ["norm"], "sent_lang": ["sents"], "ctx": ["sent_lang"], "context": ["norm", "ctx", "sent_lang"], "strategies": ["counts"], "wide": ["strategies", "grams", "attr"], "plain": ["wide"], "han_split": ["wide"],
    "contrib": ["wide", "attr", "plain", "han_split", "fw", "dict", "ends", "sent_lang"], "weights": ["contrib"], "totals": ["weights"], "fine": ["weights", "totals"], "macros": ["fine"], "ranked": ["macros"], "tops": ["ranked"],
    "variant": ["fine", "tops"], "state": ["counts", "tops", "variant", "context", "signals"], "verdict": ["state"], "listed": ["fw", "attr", "ends", "sent_lang"], "told": ["verdict", "counts", "listed", "dict_totals", "attr", "context", "scores"],
}


def _query(final: str, *needs: str, **other: str) -> str:
    """final after the expressions it needs; other replaces some of them."""
    parts = _PARTS | other
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in order) + f"\n{final}" if order else final


_IDENTIFY = "SELECT doc_id, status, primary_language, primary_variant, CAST(n_candidates AS INTEGER) AS n_candidates, top_confidence FROM verdict"
_RESOLVE = f"""CASE WHEN regexp_matches(%s, '[{c.YUE}]') THEN 'yue' WHEN {_class('%s', c.HAN)} >= 4 AND {_set('%s', c.LZH)} >= 3 THEN 'lzh'
  WHEN regexp_matches(%s, '[{c.HANT_ONLY}]') THEN CASE WHEN regexp_matches(%s, '[{c.HK}]') AND NOT regexp_matches(%s, '[{c.TW}]') THEN 'zh-Hant-HK' WHEN regexp_matches(%s, '[{c.TW}]') AND NOT regexp_matches(%s, '[{c.HK}]') THEN 'zh-Hant-TW' ELSE 'zh-Hant' END ELSE 'zh-Hans' END"""
_ONLY_DOCS = "SELECT doc_id, text FROM documents"
_LABELS = [(f"__label__{k}" if i % 3 == 0 else k, "學生嘥時間") for i, (k, _) in enumerate(labels.label_rows())] + [("cmn_Hans", "我们"), ("cmn_Hant", "學生嘥時間"), ("__label__cmn_Hant", ""), ("xxx_Yyyy", "text")]

# Segments: runs of one script, a run of Latin letters without an attribution cut by letter, joined over white space.
_SEGMENTS = {
    "runs": f"SELECT *, sum(length(run_text)) OVER (PARTITION BY doc_id ORDER BY run) - length(run_text) AS place FROM (SELECT doc_id, norm, vi, fr, strategy, unnest(rs) AS run_text, generate_subscripts(rs, 1) AS run FROM (SELECT *, regexp_extract_all(norm, '[{c.LATIN}]+|[{c.HAN}]+|[{c.KANA}]+|[{c.HANGUL}]+|[^{c.LATIN}{c.CJK}]+') AS rs FROM strategies WHERE visible > 0 AND total > 0))",
    "regions": f"""SELECT doc_id, region, lo + length(regexp_extract(text, '^[^{c.HAN}]*')) AS lo, hi, text[length(regexp_extract(text, '^[^{c.HAN}]*')) + 1:] AS text FROM (
      SELECT doc_id, region, min(place) AS lo, max(place + length(run_text)) AS hi, string_agg(run_text, '' ORDER BY run) AS text FROM (
        SELECT *, sum(CAST(k AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY run) AS region FROM (SELECT *, regexp_matches(run_text, '^[{c.KANA}{c.HANGUL}]') AS k FROM runs WHERE strategy = 'ja')) WHERE NOT k GROUP BY doc_id, region) WHERE regexp_matches(text, '[{c.HAN}]')""",
    "overrides": f"""SELECT doc_id, lo, hi, CASE WHEN yue > 0 THEN 'yue' WHEN lzh >= 3 AND han >= 4 THEN 'lzh' WHEN hk > 0 AND tw = 0 THEN 'zh-Hant-HK' WHEN tw > 0 AND hk = 0 THEN 'zh-Hant-TW' WHEN hant > 0 AND hans = 0 THEN 'zh-Hant' WHEN hans > 0 AND hant = 0 THEN 'zh-Hans' END AS tag
      FROM (SELECT *, {_class('text', c.HAN)} AS han, {', '.join(f"{_set('text', v)} AS {k}" for k, v in c.MARKERS.items())} FROM regions) WHERE hans + hant + yue + lzh + hk + tw > 0""",
    "cut": f"""SELECT doc_id, run, place, run_text, strategy, vi, fr, token_lang.lang AS known, CASE WHEN token_lang.lang IS NOT NULL OR NOT regexp_matches(run_text, '^[{c.LATIN}]') THEN [run_text]
        ELSE regexp_extract_all(run_text, '[{c.VI_MARKERS}]+|[{c.FR_MARKERS}]+|[A-Za-z]+|.') END AS ps, norm FROM runs LEFT JOIN token_lang ON run_text = token""",
    "pieces": f"""SELECT doc_id, norm, run, i, a, b, CASE WHEN regexp_matches(p, '^[{c.LATIN}]') THEN coalesce(known, CASE WHEN regexp_matches(p, '^[{c.VI_MARKERS}]') THEN 'vi' WHEN regexp_matches(p, '^[{c.FR_MARKERS}]') THEN 'fr'
          WHEN regexp_matches(p, '^[A-Za-z]') THEN CASE WHEN fr > 0 AND vi = 0 THEN 'fr' ELSE 'en' END WHEN vi > 0 THEN 'vi' WHEN fr > 0 THEN 'fr' ELSE 'en' END)
        WHEN regexp_matches(p, '^[{c.HAN}]') THEN coalesce((SELECT max(tag) FROM overrides o WHERE o.doc_id = x.doc_id AND o.lo <= x.a AND x.a < o.hi), strategy) WHEN regexp_matches(p, '^[{c.KANA}]') THEN 'ja' WHEN regexp_matches(p, '^[{c.HANGUL}]') THEN 'ko' END AS lang
      FROM (SELECT *, place + sum(length(p)) OVER (PARTITION BY doc_id, run ORDER BY i) - length(p) AS a, place + sum(length(p)) OVER (PARTITION BY doc_id, run ORDER BY i) AS b FROM (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM cut)) x""",
    "islands": """SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM (SELECT *, CASE WHEN lag(lang) OVER w = lang AND trim(substr(norm, CAST(lag(b) OVER w AS BIGINT) + 1, CAST(a - lag(b) OVER w AS BIGINT)), ' ') = '' THEN 0 ELSE 1 END AS fresh
      FROM pieces WHERE lang IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY a))""",
}
_PARTS |= _SEGMENTS
_NEEDS |= {"runs": ["strategies"], "regions": ["runs"], "overrides": ["regions"], "cut": ["runs", "token_lang"], "pieces": ["cut", "overrides"], "islands": ["pieces"]}

_ML = {
    "input": _ML_TEXTS,
    "signals": _ML_SIGNALS,
    "contrib": _PARTS["contrib"] + f" UNION ALL SELECT doc_id, 10 + ord, tag, least({_f('0.30')} * conf, {_f('0.30')}) FROM ({_ML_SCORES})",
    "scores": f"SELECT i AS doc_id, {_text(c.ML_NOTE)} || coalesce(string_agg(p, ', ' ORDER BY p), '') AS note FROM range({len(fixtures.SCORES)}) r(i) LEFT JOIN (SELECT doc_id, tag || ':' || printf('%.2f', conf) AS p FROM ({_ML_SCORES})) s ON i = doc_id GROUP BY i",
}
_FROM_SCORES = f"{fixtures.score_id(0)} - doc_id AS doc_id"
_DECLARED_SCORES = f"SELECT doc_id, 0 AS ord, lang AS tag, {_f(fixtures.DECLARED[0])} AS conf FROM documents WHERE lang IS NOT NULL UNION ALL SELECT {_FROM_SCORES}, ord, tag, conf FROM ({_ML_SCORES})"
_ML_DOCUMENTS = {
    "input": f"{_DOC_TEXTS} UNION ALL SELECT {_FROM_SCORES}, text FROM ({_ML_TEXTS})",
    "signals": f"SELECT doc_id, lang AS label, CAST({fixtures.DECLARED[1]} AS DOUBLE) AS conf FROM documents WHERE lang NOT IN ({_strings(c.TAGS)}) AND doc_id % 2 = 0 UNION ALL SELECT {_FROM_SCORES}, label, CAST(conf AS DOUBLE) FROM ({_ML_SIGNALS})",
    "contrib": _PARTS["contrib"] + f" UNION ALL SELECT doc_id, 10 + ord, tag, least({_f('0.30')} * conf, {_f('0.30')}) FROM ({_DECLARED_SCORES})",
    "scores": f"SELECT doc_id, {_text(c.ML_NOTE)} || coalesce(string_agg(p, ', ' ORDER BY p), '') AS note FROM (SELECT doc_id FROM documents WHERE lang IS NOT NULL UNION ALL SELECT {_FROM_SCORES} FROM range({len(fixtures.SCORES)}) r(doc_id)) LEFT JOIN (SELECT doc_id, tag || ':' || printf('%.2f', conf) AS p FROM ({_DECLARED_SCORES})) USING (doc_id) GROUP BY doc_id",
}
_LINES = {"input": "SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"}
_DECLARED = "(SELECT d.lang, d.source, v.* FROM verdict v JOIN documents d USING (doc_id))"

#: The corpus's lexicon for the tags that lexicons are known for, and the seed for the others.
_DERIVED = f"""WITH found AS (SELECT lang, rank, word FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (
      SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[{c.LATIN}]{{2,}}')) AS word FROM documents WHERE lang IN ({_strings(c.LEXICON_TAGS)})) GROUP BY ALL)) WHERE rank <= 10000)
    SELECT * FROM found UNION ALL SELECT * FROM (VALUES {_values(seed_rows())}) l(lang, rank, word) WHERE lang NOT IN (SELECT lang FROM found)"""
#: A classifier's predictions for every document and fixture text, that the id alone tells: (label, confidence) by place.
PREDICTED = [("eng_Latn", 0.5), ("__label__fra_Latn", 0.25), ("cmn_Hant", 0.125), ("xxx_Yyyy", 0.75), ("spa_Latn", 0.25), ("__label__cmn_Hans", 0.0625), ("yue_Hant", 0.5)]
_PREDICTIONS = f"SELECT doc_id, text, label, CAST(conf AS FLOAT) AS conf FROM ({_DOC_TEXTS}) d JOIN (VALUES {_values((i, *p) for i, p in enumerate(PREDICTED))}) p(place, label, conf) ON (abs(doc_id) + place) % 3 <> 0"

SQL = {
    "has_yue_marker": _query(f"SELECT doc_id, regexp_matches(norm, '[{c.YUE}]') AS has_yue_marker FROM norm", "norm"),
    "is_classical_chinese": _query(f"SELECT doc_id, {_class('norm', c.HAN)} >= 4 AND {_set('norm', c.LZH)} >= 3 AS is_classical_chinese FROM norm", "norm"),
    "classifier_signals": f"""WITH top AS (SELECT *, regexp_replace(label, '^__label__', '') AS bare, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, label) AS r FROM ({_PREDICTIONS}) QUALIFY r <= 5),
      tagged AS (SELECT top.*, CASE WHEN bare IN ('cmn_Hans', 'cmn_Hant') THEN {_RESOLVE.replace('%s', "coalesce(text, '')")} ELSE t.tag END AS tag FROM top LEFT JOIN (VALUES {_values(labels.label_rows())}) t(label, tag) ON bare = t.label)
      SELECT doc_id, coalesce(string_agg(tag || ':' || printf('%.4f', conf), ',' ORDER BY r) FILTER (tag IS NOT NULL), '') AS scores, max(bare) FILTER (r = 1 AND tag IS NULL) AS unsupported, max(CAST(conf AS DOUBLE)) FILTER (r = 1 AND tag IS NULL) AS unsupported_conf
      FROM tagged GROUP BY doc_id""",
    "identify_with_corpus_lexicon": _query(_IDENTIFY, "verdict", lex=_DERIVED),
    "dictionary_hits_of_corpus_lexicon": _query("SELECT doc_id, lang, hits, exclusive, shared FROM dict", "dict", lex=_DERIVED),
    "identify_json_lists": _query(
        f"""SELECT v.doc_id, CASE WHEN v.n_candidates > 0 THEN l.candidates ELSE '' END AS candidates, t.reasons, CASE WHEN v.state IN ('empty', 'refused', 'foreign') THEN '' ELSE coalesce(s.segments, '') END AS segments
      FROM verdict v JOIN told t USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(language || ':' || printf('%.2f', confidence), ',' ORDER BY r) AS candidates FROM ranked WHERE confidence >= {_f(c.KEEP_FLOOR)} GROUP BY doc_id) l USING (doc_id)
      LEFT JOIN (SELECT doc_id, string_agg(language || ':' || strlen(substr(norm, 1, a)) || ':' || strlen(substr(norm, 1, b)), ',' ORDER BY island) AS segments FROM (
        SELECT doc_id, island, any_value(norm) AS norm, any_value(lang) AS language, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM islands GROUP BY doc_id, island) GROUP BY doc_id) s USING (doc_id)""",
        "told", "ranked", "islands",
    ),
    "normalize": _query("SELECT doc_id, norm FROM norm", "norm"),
    "visible_chars": _query("SELECT doc_id, CAST(visible AS INTEGER) AS visible_chars FROM counts", "counts"),
    "script_counts": _query("SELECT doc_id, latin, hiragana, katakana, han, hangul, total AS supported, other FROM counts", "counts"),
    "ortho_markers": _query("SELECT doc_id, vi, fr, hans, hant, yue, lzh, hk, tw, nan, hak, wuu FROM counts", "counts"),
    "ngram_hits": _query("SELECT doc_id, en_hits, vi_hits FROM grams", "grams"),
    "latin_tokens": _query("SELECT doc_id, token, n FROM latin_tokens", "latin_tokens"),
    "cjk_windows": _query("SELECT doc_id, token, n FROM cjk_tokens", "cjk_tokens"),
    "function_word_hits": _query("SELECT doc_id, lang, hits FROM fw", "fw"),
    "dictionary_hits": _query("SELECT doc_id, lang, hits, exclusive, shared FROM dict", "dict"),
    "dictionary_totals": _query("SELECT doc_id, recognized, ambiguous FROM dict_totals", "dict_totals"),
    "latin_attribution": _query("SELECT doc_id, lang, n_tokens, n_chars FROM attr", "attr"),
    "cjk_endings": _query("SELECT doc_id, ja, ko, zh FROM ends", "ends"),
    "sentences": _query("SELECT doc_id, ord, sentence FROM sents", "sents"),
    "sentence_language": _query("SELECT doc_id, ord, language FROM sent_lang", "sent_lang"),
    "context_signal": _query("SELECT * FROM context", "context"),
    "resolve_zh": _query(f"SELECT doc_id, {_RESOLVE.replace('%s', 'norm')} AS tag FROM norm", "norm"),
    "openlid_map": f"""SELECT l.label, l.text, CASE WHEN bare IN ('cmn_Hans', 'cmn_Hant') THEN {_RESOLVE.replace('%s', 'l.text')} ELSE t.tag END AS tag, bare IN ('cmn_Hans', 'cmn_Hant') OR t.tag IS NOT NULL AS supported
      FROM (SELECT *, regexp_replace(label, '^__label__', '') AS bare FROM (VALUES {_values(_LABELS)}) v(label, text)) l LEFT JOIN (VALUES {_values(labels.label_rows())}) t(label, tag) ON bare = t.label""",
    "han_strategy": _query("SELECT doc_id, strategy FROM strategies", "strategies"),
    "han_run_overrides": _query("SELECT doc_id, CAST(lo AS INTEGER) AS start, CAST(hi AS INTEGER) AS stop, tag FROM overrides WHERE tag IS NOT NULL", "overrides"),
    "segments": _query(
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS ord, language, strlen(substr(norm, 1, a)) AS start, strlen(substr(norm, 1, b)) AS stop, substr(norm, a + 1, b - a) AS segment FROM (
      SELECT doc_id, island, any_value(norm) AS norm, any_value(lang) AS language, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM islands GROUP BY doc_id, island)""", "islands",
    ),
    "script_weights": _query("SELECT doc_id, tag, round(CAST(w AS DOUBLE), 5) AS w FROM weights", "weights"),
    "fine_distribution": _query("SELECT doc_id, tag AS language, round(CAST(confidence AS DOUBLE), 2) AS confidence FROM fine", "fine"),
    "macro_candidates": _query("SELECT doc_id, language, round(CAST(confidence AS DOUBLE), 2) AS confidence FROM macros", "macros"),
    "primary_variant": _query("SELECT doc_id, primary_variant FROM verdict", "verdict"),
    "calibrated_status": _query("SELECT doc_id, status, primary_language, note FROM verdict", "verdict"),
    "reasons": _query("SELECT doc_id, reasons FROM told", "told"),
    "identify": _query(_IDENTIFY, "verdict"),
    "identify_lines": _query(_IDENTIFY.replace("SELECT doc_id", "SELECT doc_id AS conv_id"), "verdict", **_LINES),
    "identify_with_ml": _query("SELECT CAST(v.doc_id AS BIGINT) AS doc_id, status, primary_language, primary_variant, CAST(n_candidates AS INTEGER) AS n_candidates, top_confidence, reasons FROM verdict v JOIN told USING (doc_id)", "told", **_ML),
    "identify_documents_with_ml": _query(f"{_IDENTIFY.split(' FROM ')[0]}, reasons FROM verdict JOIN told USING (doc_id)", "told", **_ML_DOCUMENTS),
    "macro_of": f"SELECT tag, {_macro('tag')} AS macro FROM (VALUES {_values([(t,) for t in [*c.TAGS, 'es', 'und']])}) t(tag)",
    "variants_of": f"SELECT * FROM (VALUES {_values([(m, ','.join(vs)) for m, vs in c.VARIANTS.items()] + [('es', '')])}) t(macro, variants)",
    "identify_json": _query("SELECT doc_id, status, primary_language AS primaryLanguage, primary_variant AS primaryVariant, norm AS normalizedText FROM verdict", "verdict"),
    "corpus_lexicon": f"""SELECT lang, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (
      SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[{c.LATIN}]{{2,}}')) AS word FROM documents) GROUP BY ALL)) WHERE rank <= 10000""",
    "status_by_declared_lang": _query(f"SELECT lang, status, count(*) AS n FROM {_DECLARED} GROUP BY ALL", "verdict", input=_ONLY_DOCS),
    "lang_confusion": _query(f"SELECT *, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM (SELECT lang, coalesce(primary_language, 'none') AS identified, count(*) AS n FROM {_DECLARED} GROUP BY ALL)", "verdict", input=_ONLY_DOCS),
    "language_rollup": _query(f"SELECT source, lang, status, count(*) AS n, CAST(sum(length(norm)) AS BIGINT) AS chars FROM {_DECLARED} GROUP BY ROLLUP (source, lang, status)", "verdict", input=_ONLY_DOCS),
    "stream_identify": _query("SELECT doc_id, status, primary_language, primary_variant FROM verdict", "verdict", input=_ONLY_DOCS),
}
