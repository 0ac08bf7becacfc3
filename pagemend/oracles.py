"""The results of ``queries.py`` in SQL, written independently of the operators, for DuckDB over the same tables."""

from __future__ import annotations

from .config import LINE_PASSES, WHOLE_PASSES

SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"[\p{L}\p{N}_À-ỹĐđ]+"
GARBAGE = r"[^\p{L}\p{N}_À-ỹĐđ\s\x1c-\x1f\x85\p{Z}.,;:!?…''\"“”‘’()\-–—/+%&]".replace(r"\"", '"')
EDGES = """.,;:!?…''"“”‘’()[]{}<>+-–—/*"""


def rounded(x: str, digits: int) -> str:
    """Rounded by the exact binary value, ties to even."""
    return f"format('{{:.{digits}f}}', ({x})::DOUBLE)::DOUBLE"


def plain(x: str) -> str:
    """Without diacritics."""
    return f"replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D')"


def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def core(x: str) -> str:
    return folded(f"trim({x}, '{EDGES}')")


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda t: t <> '')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def lexical(x: str) -> str:
    return f"array_to_string(regexp_extract_all({folded(x)}, '[0-9A-Za-zÀ-ỹĐđ]+'), ' ')"


def shape(x: str) -> str:
    return f"array_to_string(regexp_extract_all({folded(plain(x))}, '{WORD}'), '')"


def times(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def score_of(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 100.0::DOUBLE ELSE {times(x, GARBAGE)} * 2.0::DOUBLE + {times(x, f'[^{SPACE}]{{24,}}')} * 6.0::DOUBLE + ({times(x, r'\p{C}')} - {times(x, r'[\n\t]')}) * 10.0::DOUBLE END"


LINES = f"""lines AS (
  SELECT book, doc_id, i, trim(raw) AS text, (60 + (doc_id * 31 + i * 17) % 41)::DOUBLE AS conf, 0 AS x, 24 * i + 20 * (i // 5) AS y, 10 * length(trim(raw)) AS w, 20 + i % 3 AS h
  FROM (SELECT 'b' || (doc_id // 50) AS book, doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""
READINGS = f"""reads AS (
  SELECT book, doc_id, i, text AS anchor, conf AS line_conf, unnest([0, 1, 2, 3, 4]) AS o, conf - 2 * unnest([0, 1, 2, 3, 4]) AS conf,
    unnest([text, {plain('text')}, lower(text), CASE WHEN (doc_id + i) % 7 = 0 THEN replace(text, 'e', 'c') ELSE text END, CASE WHEN doc_id % 11 = 0 THEN text || ' ###' ELSE text END]) AS text FROM lines)"""
LEXICON = rf"lex AS (SELECT DISTINCT {folded('w')} AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}{{3,}}')) AS w FROM benchmark))"
BASE = f"WITH {LINES}, {READINGS}, {LEXICON}"

TEXTS = f"""texts AS (
  SELECT doc_id, o, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (regexp_matches(text, '[^{SPACE}]')), '') AS text,
    sum(conf) FILTER (regexp_matches(text, '[^{SPACE}]') AND conf >= 0) AS conf_sum, count(*) FILTER (regexp_matches(text, '[^{SPACE}]') AND conf >= 0) AS conf_n
  FROM reads GROUP BY doc_id, o)"""


def health(has_lexicon: bool = True) -> str:
    known = "CASE WHEN eligible > 0 THEN hits / eligible::DOUBLE END" if has_lexicon else "NULL::DOUBLE"
    return rf"""{TEXTS}, ws AS (
  SELECT doc_id, o, {folded('word')} AS core, regexp_matches(word, '\p{{Nd}}') AS digit FROM (SELECT doc_id, o, unnest({words('text')}) AS word FROM texts)
), tally AS (
  SELECT doc_id, o, count(*) AS words, count(*) FILTER (length(core) <= 2) AS short, count(*) FILTER (length(core) >= 3 AND NOT digit) AS eligible,
    count(*) FILTER (length(core) >= 3 AND NOT digit AND lex.word IS NOT NULL) AS hits FROM ws LEFT JOIN lex ON lex.word = core GROUP BY doc_id, o
), counts AS (
  SELECT t.doc_id, t.o, conf_sum, conf_n, length(text) AS length, length({stripped('text')}) AS chars, {times('text', f'[^{SPACE}]')} AS visible, {times('text', GARBAGE)} AS weird, {times('text', r'\p{L}')} AS letters,
    coalesce(words, 0) AS words, coalesce(short, 0) AS short, coalesce(eligible, 0) AS eligible, coalesce(hits, 0) AS hits FROM texts t LEFT JOIN tally USING (doc_id, o)
), ratios AS (
  SELECT *, CASE WHEN conf_n > 0 THEN conf_sum / conf_n ELSE 0 END AS conf, weird / greatest(1, visible)::DOUBLE AS g, short / greatest(1, words)::DOUBLE AS s, letters / greatest(1, visible)::DOUBLE AS l, {known} AS k FROM counts
), health AS (
  SELECT doc_id, o, 'p' || o AS source, o AS pass_order,
    {rounded("conf * 0.55::DOUBLE + l * 25.0::DOUBLE - g * 120.0::DOUBLE - s * 12.0::DOUBLE + coalesce(k * 20.0::DOUBLE, 0.0::DOUBLE) + least(length, 1600) / 1600.0::DOUBLE * 5.0::DOUBLE", 4)} AS score,
    chars, words, {rounded('conf', 4)} AS average_confidence, {rounded('g', 5)} AS garbage_ratio, {rounded('s', 5)} AS short_word_ratio, {rounded('k', 5)} AS dictionary_ratio FROM ratios)"""


BEST = "best AS (SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) = 1)"
SIMILAR = f"""folds AS (SELECT doc_id, o, array_to_string({tokens(folded(plain('text')))}, ' ') AS f FROM texts
), pairs AS (SELECT a.doc_id, least(length(a.f), length(b.f)) / greatest(length(a.f), length(b.f))::DOUBLE AS r FROM folds a JOIN folds b ON a.doc_id = b.doc_id AND a.o < b.o WHERE a.f <> '' AND b.f <> ''
), sim AS (SELECT d.doc_id, coalesce(m, 1.0) AS similarity FROM (SELECT DISTINCT doc_id FROM texts) d LEFT JOIN (SELECT doc_id, median(r) AS m FROM pairs GROUP BY doc_id) USING (doc_id))"""
REPORT = """flags AS (
  SELECT best.doc_id, source, similarity, list_filter([
    CASE WHEN garbage_ratio > 0.055 THEN 'symbol_soup' END, CASE WHEN short_word_ratio > 0.48 THEN 'fragmented_words' END, CASE WHEN dictionary_ratio < 0.28 THEN 'lexicon_collapse' END,
    CASE WHEN similarity < 0.42 THEN 'cross_pass_instability' END, CASE WHEN average_confidence < 50 THEN 'low_side_confidence' END], lambda x: x IS NOT NULL AND chars >= 80 AND words >= 12) AS reasons
  FROM best JOIN sim USING (doc_id)
), judged AS (
  SELECT d.doc_id, flags.source, similarity, reasons,
    CASE WHEN flags.source IS NULL THEN true ELSE (list_contains(reasons, 'symbol_soup') AND list_has_any(reasons, ['lexicon_collapse', 'cross_pass_instability', 'fragmented_words']))
      OR (list_contains(reasons, 'cross_pass_instability') AND list_has_any(reasons, ['lexicon_collapse', 'low_side_confidence'])) OR len(reasons) >= 3 END AS catastrophic
  FROM documents d LEFT JOIN flags USING (doc_id))"""
COLUMNS = "doc_id, source, pass_order::INT AS pass_order, score, chars::BIGINT AS chars, words::BIGINT AS words, average_confidence, garbage_ratio, short_word_ratio, dictionary_ratio"

SPELLED = f"""spelled AS (
  SELECT doc_id, i, any_value(anchor) AS text, any_value(line_conf) AS conf, count(DISTINCT {folded('text')}) FILTER (text <> '') AS exact, count(DISTINCT {folded(plain('text'))}) FILTER (text <> '') AS plain FROM reads GROUP BY doc_id, i)"""
SUSPECTS = f"""suspects AS (
  SELECT *, list_filter([CASE WHEN exact > 1 THEN 'whole_pass_disagreement' END, CASE WHEN plain < exact THEN 'diacritic_disagreement' END, CASE WHEN conf < 82 THEN 'low_word_conf' END,
    CASE WHEN {score_of('text')} >= 4 THEN 'glyph_garbage' END], lambda x: x IS NOT NULL) AS reasons FROM spelled)"""
LINE_ID = "doc_id || '-' || i AS line_id"

PAIRS = """toks AS (
  SELECT doc_id, i, o, conf, {a} AS a, {b} AS b FROM {source} WHERE text <> ''
), pairs AS (SELECT doc_id, i, o, conf, unnest(range(len(a))) AS spot, unnest(a) AS old, unnest(b) AS new FROM toks WHERE len(a) = len(b)
), named AS (SELECT *, {old} AS old_core, {new} AS new_core FROM pairs WHERE old <> new)"""


def token_pairs(source: str) -> str:
    return PAIRS.format(a=tokens("anchor"), b=tokens("text"), source=source, old=core("old"), new=core("new"))


CONSENSUS = f"""consensus AS (
  SELECT doc_id, i, CASE WHEN doc_id % 3 = 0 THEN {plain('text')} ELSE text END AS anchor, conf AS line_conf, unnest([0, 1, 2, 3, 4]) AS o, conf - 2 * unnest([0, 1, 2, 3, 4]) AS conf,
    unnest([text, text, text, text, CASE WHEN doc_id % 3 = 0 THEN {plain('text')} ELSE text END]) AS text FROM lines)"""
def refined(source: str, reason: str) -> str:
    """Repairs of the lines of ``source`` (which ends in ``consensus``): ``reason`` is null where a vote allows none; the fold keeps text, count and reasons."""
    start = "{'t': anchor, 'o': '', 'n': '', 'k': 0, 'r': ''}"
    return f"""{source}, {token_pairs('consensus')}, votes AS (
  SELECT doc_id, i, old, new, any_value(old_core) AS old_core, any_value(new_core) AS new_core, count(*) AS votes, min(o * 1000000 + spot) AS first_at
  FROM named WHERE old_core <> '' AND new_core <> '' AND ({plain('old_core')} = {plain('new_core')} OR conf >= 85) GROUP BY doc_id, i, old, new
), decided AS (SELECT * FROM (SELECT *, {reason} AS reason FROM votes) WHERE reason IS NOT NULL
), plan AS (SELECT doc_id, i, list({{'t': '', 'o': old, 'n': new, 'k': 0, 'r': reason}} ORDER BY votes DESC, first_at) AS steps FROM decided GROUP BY doc_id, i
), refined AS (
  SELECT doc_id, i, anchor, CASE WHEN steps IS NULL THEN {start} ELSE list_reduce(steps, lambda acc, s:
      CASE WHEN length(acc.t) - length(replace(acc.t, s.o, '')) = length(s.o) THEN {{'t': replace(acc.t, s.o, s.n), 'o': '', 'n': '', 'k': acc.k + 1, 'r': acc.r || CASE WHEN acc.k > 0 THEN ',' ELSE '' END || s.r}} ELSE acc END, {start}) END AS done
  FROM (SELECT DISTINCT doc_id, i, anchor FROM consensus) LEFT JOIN plan USING (doc_id, i))"""


BY_VOTES = f"""WHEN votes >= 4 AND old_core <> new_core AND {folded(plain('old_core'))} = {folded(plain('new_core'))} THEN 'valid_diacritic_visual_margin'
  WHEN votes >= 4 AND lower(old) <> lower(new) AND old_core = new_core THEN 'case_visual_consensus' END"""
REFINED = refined(CONSENSUS, f"CASE {BY_VOTES}")
DAMAGED = f"""consensus AS (
  SELECT doc_id, i, a AS anchor, conf AS line_conf, unnest([0, 1, 2, 3, 4]) AS o, conf - 2 * unnest([0, 1, 2, 3, 4]) AS conf, unnest([text, text, text, a, a]) AS text
  FROM (SELECT *, CASE WHEN (doc_id + i) % 4 = 0 THEN replace(text, 'e', 'c') ELSE text END AS a FROM lines)
), list_ AS (SELECT DISTINCT {core('t')} AS word FROM (SELECT unnest({tokens('text')}) AS t FROM lines WHERE doc_id % 2 = 0) WHERE {core('t')} <> '')"""
BY_LIST = refined(DAMAGED, f"CASE WHEN votes >= 3 AND old_core NOT IN (SELECT word FROM list_) AND new_core IN (SELECT word FROM list_) THEN 'invalid_to_valid_visual_consensus' {BY_VOTES}")
REVIEW = f"""review AS (
  SELECT s.doc_id, s.i, {rounded('any_value(s.conf)', 2)} AS conf, array_to_string(list(r.text ORDER BY r.conf DESC, r.o)[1:4], '|') AS alts, least(4, count(*)) AS n_alts
  FROM suspects s JOIN reads r USING (doc_id, i) WHERE s.conf < 82 OR len(s.reasons) > 0 GROUP BY s.doc_id, s.i)"""

FURNITURE = """extra AS (
  SELECT 'b' || (doc_id // 50) AS book, doc_id, list_concat(string_split(text, chr(10)), CASE WHEN doc_id % 5 = 0 THEN ['***', '**'] ELSE [] END, CASE WHEN doc_id % 7 = 0 THEN [''] ELSE [] END, [(doc_id % 500)::VARCHAR]) AS ls FROM documents
), fur AS (SELECT book, doc_id, len(ls) AS n, unnest(range(len(ls))) AS i, unnest(ls) AS text FROM extra
), furn AS (SELECT *, (60 + (doc_id * 31 + i * 17) % 41)::DOUBLE AS conf FROM fur)"""


def header_key(x: str) -> str:
    return f"array_to_string({tokens(f"regexp_replace(strip_accents({folded(x)}), '[^a-z0-9đ{SPACE}]', ' ', 'g')")}, ' ')"


HEADERS = f"""heads AS (
  SELECT book, key, count(*) AS times FROM (SELECT book, {header_key('text')} AS key FROM furn WHERE i < 3) WHERE length(key) BETWEEN 8 AND 90 GROUP BY book, key
), headers AS (SELECT book, key, times FROM heads JOIN (SELECT 'b' || (doc_id // 50) AS book, count(*) AS n FROM documents GROUP BY ALL) USING (book) WHERE times >= greatest(3, floor(n * 0.08::DOUBLE)))"""
DROPS = f"""kinds AS (
  SELECT doc_id, {stripped('text')} AS text, conf, CASE WHEN {stripped('text')} = '' THEN 'empty'
    WHEN regexp_full_match({stripped('text')}, '[{SPACE}\\-—–_]*[Il|1O0-9]{{1,5}}[{SPACE}\\-—–_.]*') AND (i <= 2 OR i >= n - 3) THEN 'page_number'
    WHEN headers.key IS NOT NULL AND i <= 3 THEN 'repeated_header' WHEN length({stripped('text')}) <= 2 AND NOT regexp_full_match({stripped('text')}, '[\\p{{L}}\\p{{N}}]+') THEN 'ornament' END AS reason
  FROM furn LEFT JOIN headers ON headers.book = furn.book AND headers.key = {header_key(stripped('text'))}
), drops AS (SELECT doc_id, 'drop' AS action, reason, text, {rounded('conf', 1)} AS conf FROM kinds WHERE reason IS NOT NULL)""".replace("\\\\", "\\")
PARAGRAPHS = f"""tall AS (SELECT doc_id, list_sort(list(greatest(1, h)))[count(*) // 2 + 1] AS mid FROM lines GROUP BY doc_id
), seen AS (SELECT doc_id, i, y, {stripped('text')} AS text, lag(y + h) OVER w AS floor_y, lag({stripped('text')}) OVER w AS before FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), fresh AS (SELECT seen.*, CASE WHEN before IS NOT NULL AND (y - floor_y > mid * 0.95::DOUBLE OR (length(before) < 65 AND NOT regexp_matches(before, '[.,;:]$'))) THEN 1 ELSE 0 END AS fresh FROM seen JOIN tall USING (doc_id)
), isles AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS par FROM fresh
), pars AS (SELECT doc_id, par::BIGINT AS par, {stripped("string_agg(text, ' ' ORDER BY i)")} AS text FROM isles GROUP BY doc_id, par HAVING {stripped("string_agg(text, ' ' ORDER BY i)")} <> '')"""
SIDES = "sides AS (SELECT doc_id, '===== PDF' || doc_id || ' =====' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY par) AS text FROM pars GROUP BY doc_id)"

MARKED = """marked AS (
  SELECT doc_id, string_split('preface' || chr(10) || tag || 'L =====' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || chr(10) || '  ' || tag || 'R ===== ' || chr(10) || chr(10) || string_split(text, chr(10))[1], chr(10)) AS ls
  FROM (SELECT doc_id, text, '===== PDF' || (100 + doc_id % 900) || '-' AS tag FROM documents)
), rows AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS spot FROM marked
), tagged AS (SELECT *, regexp_extract(trim(line), '^===== PDF([0-9]{3,})-([LR]) =====$', 1) AS pg, regexp_extract(trim(line), '^===== PDF([0-9]{3,})-([LR]) =====$', 2) AS sd FROM rows
), nths AS (SELECT *, count(*) FILTER (pg <> '') OVER (PARTITION BY doc_id ORDER BY spot) AS nth FROM tagged)"""

AUDIT = f"""audit AS (
  SELECT doc_id, i, CASE WHEN (doc_id + i) % 23 = 0 THEN ['whole_side_catastrophe'] ELSE reasons END AS reasons, (doc_id + i) % 29 = 0 AS edited,
    {stripped("CASE WHEN (doc_id + i) % 17 = 0 THEN text || 'zz' WHEN (doc_id + i) % 5 = 0 THEN '— ' || text WHEN (doc_id + i) % 19 = 0 THEN ' ' ELSE text END")} AS cur FROM suspects
), held AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents
), aimed AS (
  SELECT audit.*, ls, {stripped("regexp_replace(cur, '^[^0-9A-Za-zÀ-ỹĐđ]+', '')")} AS bare FROM audit JOIN held USING (doc_id)
), targets AS (
  SELECT *, CASE WHEN len(list_filter(ls, lambda x: contains(x, cur))) > 0 THEN cur WHEN bare <> '' AND len(list_filter(ls, lambda x: contains(x, bare))) > 0 THEN bare END AS target FROM aimed
), proofs AS (
  SELECT doc_id, i, count(*) FILTER (conf >= 80 AND trim(text) <> '') AS n, list(DISTINCT {lexical(stripped('text'))}) FILTER (conf >= 80 AND trim(text) <> '') AS forms FROM reads GROUP BY doc_id, i
), placed AS (
  SELECT t.*, len(forms) = 1 AND forms[1] = {lexical('cur')} AS agrees, list_filter(ls, lambda x: contains(x, target))[1] AS first_line FROM targets t JOIN proofs USING (doc_id, i)
), disposed AS (
  SELECT *, CASE WHEN len(reasons) = 0 OR edited THEN 'done' WHEN list_contains(reasons, 'whole_side_catastrophe') THEN 'collapsed'
    WHEN agrees AND len(reasons) = 1 AND reasons[1] = 'low_word_conf' AND length(cur) > 30 THEN 'stable' WHEN cur = '' THEN 'blank' WHEN target IS NULL THEN 'unresolved'
    WHEN target <> cur AND strpos(first_line, target) <= 3 AND length(first_line) > 2 * length(target) THEN 'fragment' ELSE 'queued' END AS disposition FROM placed)"""


def context(whole: str, target: str) -> str:
    return f"CASE WHEN strpos({whole}, {target}) = 0 THEN {whole}[1:520] ELSE {whole}[greatest(0, strpos({whole}, {target}) - 261) + 1 : least(length({whole}), strpos({whole}, {target}) - 1 + length({target}) + 260)] END"


def escaped(x: str) -> str:
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{named}')"
    return x


PASS_LIST = ", ".join(f"'{p.name}'" for p in WHOLE_PASSES)
LINE_PASS_LIST = ", ".join(f"'{p.name}'" for p in LINE_PASSES)

WORD_ROWS = """word_rows AS (
  SELECT doc_id, i, k, text, CASE WHEN (doc_id + k) % 13 = 0 THEN 'x' WHEN (doc_id + i + k) % 7 = 0 THEN '-1' ELSE (50 + (doc_id + i * 3 + k * 5) % 50)::VARCHAR END AS conf,
    k * 37 % 900 AS l, i * 24 + k % 3 AS t, length(text) * 10 AS wd, 20 + k % 4 AS ht
  FROM (SELECT doc_id, i, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS k FROM lines))"""

# the gate: three operations one after another, each on what the last one left
OPS = f"""given AS (
  SELECT doc_id, i, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w, (0.9::DOUBLE + ((doc_id * 7 + i) % 11) / 100.0::DOUBLE) AS sure,
    list_transform([{plain('text')}, replace(text, 'e', 'c')], lambda c: list_filter(list_transform({tokens('c')}, lambda t: {core('t')}), lambda t: t <> '')) AS cs FROM lines
), g0 AS (SELECT *, text AS t0, coalesce(w[1], '') AS o1, replace(coalesce(w[1], ''), 'e', 'c') AS n1, coalesce(w[2], '') AS o2, {plain("coalesce(w[2], '')")} AS n2, coalesce(w[3], '') AS o3, substr(coalesce(w[3], ''), 1, 2) || ' ' || substr(coalesce(w[3], ''), 3) AS n3 FROM given)"""


def gate_step(k: int) -> str:
    t, o, n = f"t{k - 1}", f"o{k}", f"n{k}"
    inner = f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"
    gaps = f"regexp_split_to_array({t}, '[\\p{{L}}\\p{{N}}_]+')"
    segment = k == 3
    want = f"list_filter(list_transform({tokens(n)}, lambda t: {core('t')}), lambda t: t <> '')"
    support = f"len(list_filter(cs, lambda c: len(list_filter(range(1, len(c) - len(want) + 2), lambda j: len(want) > 0 AND c[j:j + len(want) - 1] = want)) > 0))"
    early = f"""CASE WHEN {o} = '' OR {n} = '' THEN 'empty_token' WHEN {o} = {n} THEN 'same_value'"""
    early += f" WHEN NOT (len({tokens(n)}) BETWEEN 2 AND 3 AND len({want}) = len({tokens(n)})) THEN 'invalid_segmentation'" if segment else ""
    early += f" WHEN len(list_filter(toks, lambda x: x = {o})) <> 1 THEN 'old_not_unique_token_in_current' END"
    late = "CASE WHEN votes = 0 AND NOT same THEN 'segmentation_without_visual_or_shape_support' " if segment else "CASE "
    late += "WHEN needs IS NULL THEN 'unsupported_new' WHEN sure < needs THEN 'insufficient_confidence_for_evidence' END"
    passed = "CASE WHEN votes > 0 THEN 'segmentation_evidence' ELSE 'segmentation_shape' END" if segment else "CASE WHEN votes > 0 THEN 'ocr_evidence' ELSE 'shape_preserving' END"
    return f"""a{k} AS (SELECT *, {inner} AS toks, {gaps} AS gaps, {want} AS want, {shape(o)} <> '' AND {shape(o)} = {shape(n)} AS same FROM g{k - 1}
), b{k} AS (SELECT *, {support} AS votes, {early} AS early FROM a{k}
), c{k} AS (SELECT *, {required('0.97', 'votes', 'same')} AS needs FROM b{k}
), d{k} AS (SELECT *, coalesce(early, {late}) AS failed, {passed} AS passed FROM c{k}
), g{k} AS (SELECT * EXCLUDE (toks, gaps, want, same, votes, early, needs, failed, passed), coalesce(failed, passed) AS gate{k}, CASE WHEN failed IS NULL THEN
    array_to_string(list_transform(range(1, len(toks) + 1), lambda j: gaps[j] || CASE WHEN toks[j] = {o} THEN {n} ELSE toks[j] END), '') || gaps[len(toks) + 1] ELSE {t} END AS t{k} FROM d{k})"""


def required(base: str, votes: str, same: str) -> str:
    d = lambda x: f"{x}::DOUBLE"
    ease = lambda floor, step: f"CASE WHEN {same} THEN greatest({d('0.90')}, greatest({d(floor)}, {d(base)} - {d(step)}) - {d('0.02')}) ELSE greatest({d(floor)}, {d(base)} - {d(step)}) END"
    return f"CASE WHEN {votes} >= 2 THEN {ease('0.90', '0.05')} WHEN {votes} = 1 THEN {ease('0.92', '0.02')} WHEN {same} THEN greatest({d(base)}, {d('0.98')}) END"


XHTML_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="vi" xml:lang="vi">\n'

XHTML_PAGES = f"""WITH p AS (SELECT doc_id, '{XHTML_HEAD}<head><title>PDF' || doc_id || '</title><link rel="stylesheet" type="text/css" href="style.css"/></head>\n<body><h1>PDF' || doc_id || '</h1>' ||
        array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')), lambda x: '<p>' || {escaped('x')} || '</p>'), chr(10)) || '</body>\n</html>' AS x FROM documents)"""

# recognition failed on every thirteenth document; collapsed sides get second readings
FAILED = "CASE WHEN doc_id % 13 = 0 THEN {} ELSE {} END"
NOISY = f"""WITH {LINES}, {READINGS.replace('reads AS', 'clean AS', 1)}, reads AS (
  SELECT book, doc_id, i, anchor, line_conf, o, {FAILED.format('conf - 40', 'conf')} AS conf, {FAILED.format("translate(text, 'aeinrst', '~#|{}^@')".replace('{', '{{').replace('}', '}}').format(), 'text')} AS text FROM clean), {LEXICON}"""
NOISY_REPORT = f"{NOISY}, {health()}, {BEST}, {SIMILAR}, {REPORT}"
RESCUE = f"""again AS (SELECT doc_id, o + 5 AS o, conf, text, i FROM clean WHERE o >= 3 AND doc_id IN (SELECT doc_id FROM judged WHERE catastrophic)), joint AS (SELECT doc_id, o, conf, text, i FROM reads UNION ALL SELECT doc_id, o, conf, text, i FROM again)"""
FIRST_OPS = rf"""ops AS (SELECT book, doc_id, i, regexp_extract(text, '[\p{{L}}]+') AS w FROM lines)"""
MERGED = f"""{SPELLED.replace('spelled AS', 'c_spelled AS', 1).replace('FROM reads', 'FROM consensus')}, asked AS (
  SELECT doc_id, i FROM (SELECT *, CASE WHEN exact > 1 OR plain < exact OR conf < 82 OR {score_of('text')} >= 4 THEN 1 END AS s FROM c_spelled) WHERE s = 1 AND doc_id NOT IN (SELECT doc_id FROM judged WHERE catastrophic))"""

SQL = {
    "collapsed_sides": f"{NOISY_REPORT} SELECT doc_id, source AS best_source, array_to_string(reasons, ',') AS reasons FROM judged WHERE catastrophic",
    "evidence_union": f"{NOISY_REPORT}, {RESCUE} SELECT doc_id, CASE WHEN o < 5 THEN 'p' || o ELSE 'fallback_p' || (o - 5) END AS source, count(*) AS lines, sum(conf) AS conf_sum FROM joint GROUP BY ALL",
    "rescued_sides": f"""WITH first_ AS ({NOISY_REPORT} SELECT doc_id FROM judged WHERE catastrophic),
      second_ AS ({NOISY_REPORT.replace('texts AS (', "seen AS (SELECT doc_id, o, conf, text, i FROM reads UNION ALL SELECT doc_id, o + 5, conf, text, i FROM clean WHERE o >= 3 AND doc_id IN (SELECT doc_id FROM first_)), texts AS (", 1).replace('FROM reads GROUP BY doc_id, o)', 'FROM seen GROUP BY doc_id, o)')} SELECT doc_id, catastrophic FROM judged)
      SELECT doc_id, NOT catastrophic AS rescued, catastrophic FROM first_ JOIN second_ USING (doc_id)""",
    "side_reviews": f"{NOISY_REPORT} SELECT doc_id, 'review_whole_side' AS action, 'whole_side_catastrophe_after_fallback' AS reason, source AS selected_pass FROM judged WHERE catastrophic",
    "asked_lines": f"{NOISY_REPORT}, {CONSENSUS}, {MERGED} SELECT doc_id, count(*) AS lines, sum(i)::BIGINT AS rows_sum FROM asked GROUP BY doc_id",
    "merged_lines": f"""{NOISY_REPORT}, {REFINED.replace(' pairs AS', ' c_pairs AS').replace('FROM pairs', 'FROM c_pairs')}, {MERGED}
      SELECT r.doc_id, r.doc_id || '-' || r.i AS line_id, CASE WHEN a.doc_id IS NULL THEN c.anchor ELSE done.t END AS text, CASE WHEN a.doc_id IS NULL THEN 0 ELSE done.k END::BIGINT AS n_edits
      FROM refined r JOIN (SELECT DISTINCT doc_id, i, anchor FROM consensus) c USING (doc_id, i) LEFT JOIN asked a USING (doc_id, i)""",
    "report_json": f"""{NOISY_REPORT}, f AS (SELECT doc_id, max(CASE WHEN o = 4 THEN words END) AS last_words FROM health GROUP BY doc_id)
      SELECT doc_id, catastrophic, source AS best_source, {rounded('similarity', 4)} AS similarity, 'p0' AS first_source, last_words::BIGINT AS last_words, len(reasons)::BIGINT AS n_reasons FROM judged JOIN f USING (doc_id)""",
    "average_confidences": f"{NOISY}, {health()} SELECT doc_id, source, average_confidence FROM health",
    "tsv_words": f"""WITH {LINES}, {WORD_ROWS} SELECT doc_id, i // 10 AS block, i::INT AS line, count(*) AS words, sum(l)::BIGINT AS left_sum, md5(string_agg(text, ' ' ORDER BY k)) AS text_md5 FROM word_rows GROUP BY doc_id, i""",
    "lexicon_words": f"SELECT DISTINCT {folded(stripped('w'))} AS word FROM (SELECT unnest(regexp_split_to_array(text, '\\s')) AS w FROM benchmark) WHERE {stripped('w')} <> ''",
    "reply_ops": f"WITH {LINES}, {FIRST_OPS} SELECT book, doc_id || '-' || i AS item_id, 2::BIGINT AS n_ops, w AS old, w || '+' AS new, true AS second_is_none FROM ops",
    "queue_with_replies": f"{BASE}, {SPELLED}, {SUSPECTS}, {AUDIT} SELECT doc_id, i::INT AS row_no, CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 0 END::BIGINT AS n_ops FROM disposed WHERE disposition = 'queued'",
    "pass_health": f"{BASE}, {health()} SELECT {COLUMNS} FROM health",
    "pass_health_no_lexicon": f"{BASE}, {health(False)} SELECT {COLUMNS} FROM health",
    "best_pass": f"{BASE}, {health()}, {BEST} SELECT doc_id, source, score FROM best",
    "chosen_pass_counts": f"{BASE}, {health()}, {BEST} SELECT source, count(*) AS sides FROM best GROUP BY source",
    "side_health": f"{BASE}, {health()}, {BEST}, {SIMILAR}, {REPORT} SELECT doc_id, catastrophic, source AS best_source, {rounded('similarity', 4)} AS cross_pass_similarity, array_to_string(reasons, ',') AS reasons FROM judged",
    "rescue_counts": f"""WITH late AS ({BASE}, {health().replace("FROM reads GROUP", "FROM reads WHERE o >= 3 GROUP")}, {BEST}, {SIMILAR}, {REPORT} SELECT doc_id, catastrophic AS a FROM judged),
      full_ AS ({BASE}, {health()}, {BEST}, {SIMILAR}, {REPORT} SELECT doc_id, catastrophic AS b FROM judged)
      SELECT count(*) AS sides, count(*) FILTER (a) AS triggered, count(*) FILTER (a AND NOT b) AS rescued, count(*) FILTER (b) AS unresolved FROM late JOIN full_ USING (doc_id)""",
    "side_scores": f"""{BASE}, t AS (SELECT doc_id, o, string_agg(text, chr(10) ORDER BY i) AS text, avg(conf) FILTER (regexp_matches(text, '[^{SPACE}]')) AS conf FROM reads GROUP BY doc_id, o)
      SELECT doc_id, 'p' || o AS source, coalesce(conf, 0) + least(length({stripped('text')}), 1800) / 1800.0::DOUBLE * 5.0::DOUBLE - ({score_of('text')}) AS side_score FROM t""",
    "garbage_scores": f"SELECT doc_id, {score_of('text')} AS garbage_score, {times('text', GARBAGE)}::BIGINT AS weird, {times('text', f'[^{SPACE}]')}::BIGINT AS visible FROM documents",
    "token_forms": f"""WITH {LINES}, t AS (SELECT token, count(*) AS times FROM (SELECT unnest({tokens('text')}) AS token FROM lines) GROUP BY token)
      SELECT token, times, {core('token')} AS core, {shape('token')} AS shape, {lexical('token')} AS lexical, token <> {plain('token')} AND {folded(plain('token'))} = {folded(plain('token'))} AS accented FROM t""",
    "words_to_lines": f"""WITH {LINES}, {WORD_ROWS}, g AS (
        SELECT doc_id, i, min(k) AS k, string_agg(trim(text), ' ' ORDER BY k) AS text, coalesce(avg(try_cast(conf AS DOUBLE)) FILTER (try_cast(conf AS DOUBLE) >= 0), 0) AS conf,
          min(l) FILTER (conf <> 'x') AS x0, min(t) FILTER (conf <> 'x') AS y0, max(l + wd) FILTER (conf <> 'x') AS x1, max(t + ht) FILTER (conf <> 'x') AS y1 FROM word_rows WHERE trim(text) <> '' GROUP BY doc_id, i
      ), b AS (SELECT doc_id, k, i, text, conf, trunc(x0 / 2.5::DOUBLE)::INT AS x, trunc(y0 / 2.5::DOUBLE)::INT AS y, trunc((x1 - x0) / 2.5::DOUBLE)::INT AS w, trunc((y1 - y0) / 2.5::DOUBLE)::INT AS h FROM g WHERE x0 IS NOT NULL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, k, i) AS row_no, text, round_even(conf, 6) AS conf, x, y, w, h FROM b""",
    "words_to_readings": f"""WITH {LINES}, {WORD_ROWS} SELECT doc_id, i::INT AS line, string_agg(trim(text), ' ' ORDER BY k) AS text, round_even(coalesce(avg(try_cast(conf AS DOUBLE)) FILTER (try_cast(conf AS DOUBLE) >= 0), 0), 6) AS conf
      FROM word_rows WHERE trim(text) <> '' AND try_cast(conf AS DOUBLE) IS NOT NULL GROUP BY doc_id, i""",
    "anchor_lines": f"""WITH {FURNITURE} SELECT doc_id, lpad((doc_id % 900)::VARCHAR, 3, '0') || '-' || CASE WHEN doc_id % 2 = 0 THEN 'L' ELSE 'R' END || '-L' || lpad((i + 1)::VARCHAR, greatest(3, length((i + 1)::VARCHAR))::INT, '0') AS line_id, {stripped('text')} AS text, conf
      FROM furn WHERE regexp_matches(text, '[^{SPACE}]')""",
    "crop_boxes": f"""WITH {LINES}, p AS (SELECT *, 900 + doc_id % 100 AS iw, 1400 + doc_id % 50 AS ih FROM lines), q AS (SELECT *, greatest(25, trunc(iw * 0.06::DOUBLE)) AS px, greatest(22, trunc(ih * 0.025::DOUBLE)) AS py FROM p)
      SELECT doc_id, i::INT AS row_no, greatest(0, x - px)::BIGINT AS x0, greatest(0, y - py)::BIGINT AS y0, least(iw, x + w + px)::BIGINT AS x1, least(ih, y + h + py)::BIGINT AS y1 FROM q""",
    "side_jobs": f"""SELECT book, chunk, name, count(*) AS sides, min(doc_id) AS first_doc FROM (SELECT 'b' || (doc_id // 50) AS book, doc_id, (row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1) // 2 AS chunk FROM documents), (SELECT unnest([{PASS_LIST}]) AS name) GROUP BY ALL""",
    "line_jobs": f"""{BASE}, {SPELLED}, {SUSPECTS}, s AS (SELECT 'b' || (doc_id // 50) AS book, doc_id, i FROM suspects JOIN documents USING (doc_id) WHERE len(reasons) > 0),
      c AS (SELECT book, (row_number() OVER (PARTITION BY book ORDER BY doc_id, i) - 1) // 28 AS chunk FROM s) SELECT book, name, count(*) AS lines, count(DISTINCT chunk) AS processes FROM c, (SELECT unnest([{LINE_PASS_LIST}]) AS name) GROUP BY ALL""",
    "spellings": f"{BASE}, {SPELLED} SELECT {LINE_ID}, exact::INT AS exact, plain::INT AS plain FROM spelled",
    "suspect_reasons": f"""{BASE}, {SPELLED}, {SUSPECTS}, tk AS (SELECT doc_id, i, unnest({tokens('text')}) AS token, unnest(range(len({tokens('text')}))) AS spot FROM suspects),
      odd AS (SELECT doc_id, i, list(c ORDER BY spot) AS cs FROM (SELECT doc_id, i, spot, {core('token')} AS c FROM tk) WHERE length(c) >= 3 AND NOT regexp_matches(c, '\\p{{Nd}}') AND NOT EXISTS (SELECT 1 FROM lex WHERE word = c) GROUP BY doc_id, i)
      SELECT {LINE_ID}, array_to_string(list_concat(reasons, CASE WHEN cs IS NULL THEN [] ELSE ['non_dictionary:' || array_to_string(cs[1:4], ',')] END), '|') AS reasons FROM suspects LEFT JOIN odd USING (doc_id, i)""",
    "token_votes": f"""{BASE}, others AS (SELECT * FROM reads WHERE o > 0), {token_pairs('others')} SELECT {LINE_ID}, old, new, count(*) AS votes, array_to_string(list_sort(list(DISTINCT 'p' || o)), ',') AS sources
      FROM named WHERE old_core <> '' AND new_core <> '' AND ({plain('old_core')} = {plain('new_core')} OR conf >= 85) GROUP BY doc_id, i, old, new""",
    "shape_votes": f"""{BASE}, {token_pairs('reads')} SELECT {LINE_ID}, old, new, count(*) AS votes FROM named WHERE old_core <> '' AND new_core <> '' AND {plain('old_core')} = {plain('new_core')} GROUP BY doc_id, i, old, new""",
    "refined_lines": f"WITH {LINES}, {REFINED} SELECT {LINE_ID}, done.t AS text, done.k::BIGINT AS n_edits FROM refined",
    "refine_audit": f"""WITH {LINES}, {REFINED}, forms AS (
        SELECT c.doc_id, c.i, any_value(done.t) AS text, any_value(done.k) AS k, any_value(line_conf) AS conf, any_value(c.text) FILTER (o = 0) AS q1, count(DISTINCT {folded('c.text')}) FILTER (c.text <> '') AS exact, count(DISTINCT {folded(plain('c.text'))}) FILTER (c.text <> '') AS plain
        FROM consensus c JOIN refined USING (doc_id, i) GROUP BY c.doc_id, c.i)
      SELECT {LINE_ID}, q1 AS before, text AS after, k::BIGINT AS n_edits FROM forms WHERE exact > 1 OR plain < exact OR conf < 82 OR {score_of('text')} >= 4""",
    "review_items": f"{BASE}, {SPELLED}, {SUSPECTS}, {REVIEW} SELECT {LINE_ID}, conf, alts, n_alts::BIGINT AS n_alts FROM review",
    "repeated_headers": f"WITH {FURNITURE}, {HEADERS} SELECT book, key, times FROM headers",
    "cleanup_drops": f"WITH {FURNITURE}, {HEADERS}, {DROPS} SELECT * FROM drops",
    "cleanup_reason_counts": f"WITH {FURNITURE}, {HEADERS}, {DROPS} SELECT reason, count(*) AS lines FROM drops GROUP BY reason",
    "paragraphs": f"WITH {LINES}, {PARAGRAPHS} SELECT doc_id, par, text FROM pars",
    "cleaned_text": f"WITH {LINES}, {PARAGRAPHS}, {SIDES} SELECT doc_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM sides",
    "book_texts": f"""WITH {LINES}, {PARAGRAPHS}, {SIDES}, b AS (SELECT 'b' || (doc_id // 50) AS book, string_agg(sides.text, chr(10) || chr(10) || chr(10) ORDER BY doc_id) || chr(10) AS text FROM sides GROUP BY ALL)
      SELECT book, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM b""",
    "marker_sides": f"""WITH {MARKED}, s AS (SELECT doc_id, nth, max(pg) AS pg, max(sd) AS sd, string_agg(line, chr(10) ORDER BY spot) FILTER (pg = '') AS body FROM nths WHERE nth > 0 GROUP BY doc_id, nth),
      p AS (SELECT *, list_filter(list_transform(string_split(coalesce(body, ''), chr(10) || chr(10)), lambda x: {stripped('x')}), lambda x: x <> '') AS ps FROM s)
      SELECT doc_id, nth AS ord, pg::INT AS page, sd AS side, len(ps)::BIGINT AS n_paragraphs, md5(array_to_string(ps, '|')) AS paragraphs_md5 FROM p""",
    "marker_lines": f"""WITH {MARKED}, s AS (SELECT doc_id, trim(line) AS line, spot, pg, max(pg) OVER w AS p, max(sd) OVER w AS s FROM nths WINDOW w AS (PARTITION BY doc_id, nth))
      SELECT doc_id, p::INT AS page, s AS side, count(*)::BIGINT AS n_lines, md5(string_agg(line, '|' ORDER BY spot)) AS lines_md5 FROM s WHERE pg = '' AND line <> '' AND p <> '' GROUP BY doc_id, p, s""",
    "refined_with_lexicon": f"WITH {LINES}, {BY_LIST} SELECT {LINE_ID}, done.t AS text, done.k::BIGINT AS n_edits, done.r AS reasons FROM refined",
    "prompt_batches": f"""{BASE}, {SPELLED}, {SUSPECTS}, {AUDIT}, b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) // 6 AS batch_no FROM disposed WHERE disposition = 'queued')
      SELECT doc_id, batch_no, true AS instructed, count(*) AS items FROM b GROUP BY ALL""",
    "queue_dispositions": f"{BASE}, {SPELLED}, {SUSPECTS}, {AUDIT} SELECT doc_id, i::INT AS row_no, disposition FROM disposed",
    "deep_queue": f"""{BASE}, {SPELLED}, {SUSPECTS}, {AUDIT}, w AS (SELECT *, array_to_string(ls, chr(10) || chr(10)) AS whole FROM disposed WHERE disposition = 'queued'),
      said AS (SELECT r.doc_id, r.i, list({stripped('r.text')} ORDER BY CASE WHEN o < 2 THEN o - 10 ELSE o END) AS c0 FROM reads r GROUP BY r.doc_id, r.i),
      cand AS (SELECT w.*, list_filter(list_transform(range(1, len(c0) + 1), lambda j: CASE WHEN list_position(c0, c0[j]) = j THEN c0[j] END), lambda x: x IS NOT NULL AND x <> '' AND {lexical('x')} <> {lexical('cur')}) AS cs FROM w JOIN said USING (doc_id, i))
      SELECT doc_id, i::INT AS row_no, cur AS current, target AS output_line, md5({context('whole', 'target')}) AS context_md5, array_to_string(cs[1:8], '|') AS candidates FROM cand""",
    "queue_context": f"""WITH h AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents), g AS (SELECT doc_id, array_to_string(ls, chr(10) || chr(10)) AS whole, coalesce(ls[2], 'no such line') AS target FROM h)
      SELECT doc_id, md5({context('whole', 'target')}) AS context_md5, length({context('whole', 'target')})::BIGINT AS n_chars FROM g""",
    "micro_batches": "SELECT conv_id, turn, conv_id // 64 AS lane, (row_number() OVER (PARTITION BY conv_id // 64 ORDER BY conv_id, turn) - 1) // 6 AS batch_no FROM conversations",
    "gate_required_confidence": f"""WITH r AS (SELECT (id % 4)::INT AS new_votes, id % 8 >= 4 AS same_shape, CASE WHEN id >= 8 THEN 0.91::DOUBLE ELSE 0.97::DOUBLE END AS base FROM range(12) t(id))
      SELECT new_votes, same_shape, base, round_even(CASE WHEN base = 0.97::DOUBLE THEN {required('0.97', 'new_votes', 'same_shape')} ELSE {required('0.91', 'new_votes', 'same_shape')} END, 6) AS required FROM r""",
    "gate_apply": f"WITH {LINES}, {OPS}, {gate_step(1)}, {gate_step(2)}, {gate_step(3)} SELECT doc_id, i::INT AS row_no, t3 AS corrected, gate1 || ',' || gate2 || ',' || gate3 AS gates FROM g3",
    "patched_text": f"""WITH {LINES}, f AS (SELECT doc_id, i, regexp_extract(text, '[\\p{{L}}]+') AS old FROM lines), c AS (SELECT doc_id, old, min(i) AS place FROM f WHERE old <> '' GROUP BY doc_id, old),
      p AS (SELECT doc_id, list({{'t': '', 'o': old, 'a': 0, 'm': 0}} ORDER BY place) AS steps FROM c GROUP BY doc_id),
      d AS (SELECT doc_id, CASE WHEN steps IS NULL THEN {{'t': text, 'o': '', 'a': 0, 'm': 0}} ELSE list_reduce(steps, lambda acc, s: CASE WHEN length(acc.t) - length(replace(acc.t, s.o, '')) = length(s.o)
        THEN {{'t': replace(acc.t, s.o, s.o || '+'), 'o': '', 'a': acc.a + 1, 'm': acc.m}} ELSE {{'t': acc.t, 'o': '', 'a': acc.a, 'm': acc.m + 1}} END, {{'t': text, 'o': '', 'a': 0, 'm': 0}}) END AS done FROM documents LEFT JOIN p USING (doc_id))
      SELECT doc_id, md5(done.t) AS text_md5, done.a::BIGINT AS patched, done.m::BIGINT AS missed FROM d""",
    "xhtml_escape": f"SELECT page_id, md5({escaped('html')}) AS html_md5, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages",
    "xhtml_pages": f"""{XHTML_PAGES}
      SELECT doc_id, length(x)::BIGINT AS n_chars, md5(x) AS xhtml_md5 FROM p""",
    "epub_books": f"""{XHTML_PAGES}
      SELECT 'b' || (doc_id // 50) AS book, count(*)::INT AS pages, count(*)::INT AS read, md5(string_agg(x, '' ORDER BY doc_id)) AS xhtml_md5 FROM p GROUP BY ALL""",
    "extract_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "fenced_json": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS json FROM events",
    "clean_confidences": f"WITH {LINES}, {WORD_ROWS} SELECT doc_id, sum(coalesce(try_cast(conf AS DOUBLE), -1)) AS conf_sum, count(*) FILTER (coalesce(try_cast(conf AS DOUBLE), -1) >= 0) AS known FROM word_rows GROUP BY doc_id",
    "run_summary": f"""{BASE}, {SPELLED}, {SUSPECTS}, {REVIEW}, {REFINED}, {FURNITURE}, {HEADERS}, {DROPS}, {PARAGRAPHS}
      SELECT (SELECT count(*) FROM documents) AS sides_in, (SELECT count(DISTINCT doc_id) FROM pars) AS sides_out, (SELECT count(*) FROM pars) AS paragraphs, (SELECT count(*) FROM drops) AS cleanup_drops,
        (SELECT count(*) FROM headers) AS repeated_headers, (SELECT sum(done.k)::BIGINT FROM refined) AS edits, (SELECT count(*) FROM review) AS review_flags""",
}
