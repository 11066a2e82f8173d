"""Scalar text functions (S) as SQL operators over whole tables."""

from quillspark.operators import spelling
from quillspark.plans.dialect import draft, items, lines, operator, pairs, roman, with_
from quillspark.plans.search import MARK

operator("s_01_fold", lambda d: f"SELECT doc_id, {d.fold('text')} AS folded FROM documents")
operator("s_02_fold_letters", lambda d: with_(lines(d)) + f"SELECT doc_id, ord, {d.rx(d.fold('line'), '[^a-z]+')} AS letters FROM lines")
operator("s_03_slug", lambda d: with_(lines(d)) + f"SELECT doc_id, ord, substring({d.rx(d.rx(d.fold('line'), '[^a-z0-9]+', '-'), '^-+|-+$')}, 1, 60) AS slug FROM lines")
operator(
    "s_04_clean_line",
    lambda d: with_(lines(d)) + f""", m AS (SELECT doc_id, ord, concat('[', CAST(ord + 1 AS STRING), '.]{{.pnum}} *', line, '*[^3] {chr(92) * (1 if d.name == 'duck' else 2)}# ') AS line FROM lines)
    SELECT doc_id, ord, trim({d.rx(d.rx(d.rx(d.rx('line', r'\[\^[0-9]+\]'), r'\[([^\]]*)\]\{[.][A-Za-z0-9_]+\}', '$1'), '[*]+'), '[\\\\](.)', '$1')}) AS clean FROM m""",
)
operator("s_06_numbers", lambda d: f"SELECT doc_id, {d.join(d.distinct(d.all(d.rx('text', MARK), '[0-9]+')), ',')} AS numbers FROM documents WHERE text IS NOT NULL")


operator("s_07_roman", lambda d: f"WITH n AS (SELECT o_orderkey, o_orderkey % 4100 AS n FROM orders) SELECT o_orderkey, {roman(d, 'n')} AS roman FROM n")
# S-08: marks left by masking, in order.
operator(
    "s_08_marks",
    lambda d: with_(lines(d)) + f", m AS (SELECT doc_id, ord, concat('<i', CAST(ord AS STRING), '>', line, '</i', CAST(ord AS STRING), '><br>') AS t FROM lines) SELECT doc_id, ord, {d.join(d.all('t', MARK), ' ')} AS marks FROM m",
)
# S-11: mechanical fixes: a full stop that the source lacks, asterisks and emphasis marks that it lacks.
operator(
    "s_11_mechanical_fix",
    lambda d: with_(pairs(d)) + f""", t AS (SELECT conv_id, turn, {d.rx('src', '[ \t\n.]+$')} AS f, trim({d.rx('out', '[\t\n ]+$')}) AS s FROM pairs),
    a AS (SELECT conv_id, turn, f, CASE WHEN f <> '' AND {d.has('s', '[.]$')} AND NOT {d.has('s', '[.][.]$')} AND {d.has('f', "[0-9A-Za-zÀ-ÿ’']$")} THEN trim(substring(s, 1, CAST(length(s) - 1 AS INT))) ELSE s END AS s FROM t),
    b AS (SELECT conv_id, turn, f, CASE WHEN NOT {d.contains('f', "'*'")} THEN replace(s, '*', '') ELSE s END AS s FROM a)
    SELECT conv_id, turn, CASE WHEN NOT {d.has('f', '<[ib][0-9]+>')} THEN {d.rx('s', '</?[ib][0-9]+>')} ELSE s END AS fixed FROM b""",
)
# What a refusal says anywhere, what it says at its start, and what in the source explains the latter.
REFUSAL = "(?i)(n[ãa]o posso (ajudar|traduzir|atender|fornecer)|n[ãa]o (me )?sinto confort|i can'?t (help|assist|translate)|i cannot (help|assist|translate|provide)|as an ai|como (uma )?ia\\b|como modelo de linguagem)"
REFUSAL_START = "(?i)(desculp[ae]|sinto muito|lamento|i'm sorry|i am sorry|infelizmente|n[ãa]o [ée] apropriado|conte[úu]do (sens[íi]vel|ofensivo|prejudicial))"
APOLOGY = "(?i)(apolog|sorry|excus|regret|unfortunate|desculp|lament|infeliz|leider|entschuldig|bedauer)"


def refusal(d, out: str, src: str) -> str:
    return f"({d.has(out, REFUSAL)} OR ({d.has(f'substring({out}, 1, 80)', REFUSAL_START)} AND NOT {d.has(f'substring({src}, 1, 160)', APOLOGY)}))"


operator(
    "s_12_refusal",
    lambda d: with_(pairs(d)) + f", v AS (SELECT conv_id, turn, src, CASE conv_id % 5 WHEN 0 THEN concat('I am sorry, but ', out) WHEN 1 THEN concat(out, ' I cannot translate this.') ELSE out END AS out FROM pairs) SELECT conv_id, turn, {refusal(d, 'out', 'src')} AS refused FROM v",
)
# S-13: strong words of the source against their strong equivalents in the output; entries as (source pattern, output pattern).
STRONG = (("damn(?:ed)?", "maldi|danad|desgraç"), ("idiot[a-z]*", "idiot|imbec|cretin"), ("stupid[a-z]*", "est[úu]pid|idiot|burr"), ("scum", "escória|ralé|escum"), ("pathetic", "patétic|ridícul"), ("filth[a-z]*", "imund|sujeir"))


def softened(d, src: str, out: str) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {d.n(f'lower({src})', a)} > {d.n(f'lower({out})', b)} THEN {d.lit(a[:6])} END" for a, b in STRONG) + ")"


operator("s_13_softening", lambda d: f"SELECT doc_id, {softened(d, 'text', '''replace(text, 'idiot', 'tolo')''')} AS lost FROM documents WHERE text IS NOT NULL")
operator("s_14_crude_guide", lambda d: "SELECT doc_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {d.has('lower(text)', a)} THEN {d.lit(a[:6] + ' = ' + b)} END" for a, b in STRONG) + ") AS hint FROM documents WHERE text IS NOT NULL")
COMMON_EN = "'the', 'of', 'and', 'to', 'that', 'is', 'in', 'it', 'for', 'with', 'as', 'was', 'be', 'this', 'are', 'not', 'by', 'on', 'or', 'which', 'they', 'have', 'from', 'their'"
COMMON_PT = "'de', 'que', 'não', 'uma', 'para', 'com', 'os', 'das', 'dos', 'como', 'mais', 'se', 'em', 'por', 'é', 'ao', 'as', 'do', 'da', 'no', 'na', 'um', 'e', 'o', 'a'"
# S-15: lines of six words or more that are still in the source language.
operator(
    "s_15_left_in_source",
    lambda d: with_(lines(d)) + f""", w AS (SELECT doc_id, ord, {d.all('lower(line)', '[a-zà-ÿ]+')} AS p FROM lines),
    c AS (SELECT doc_id, ord, {d.size('p')} AS n, {d.size(d.keep('p', 'x', f'x IN ({COMMON_EN})'))} AS o, {d.size(d.keep('p', 'x', f'x IN ({COMMON_PT})'))} AS t FROM w)
    SELECT doc_id, ord, n, o, t FROM c WHERE n >= 6 AND o >= 3 AND o > 2 * t""",
)
# S-16: glossary: the decided word must come as often as the term does.
operator("s_16_glossary_check", lambda d: with_(pairs(d)) + f"SELECT conv_id, turn, {d.n('lower(src)', 'tion[a-z]*')} AS wanted, {d.n('lower(out)', 'anly[a-z]*')} AS found FROM pairs WHERE {d.n('lower(src)', 'tion[a-z]*')} > {d.n('lower(out)', 'anly[a-z]*')}")
# S-19: problems that not even the judge may release.
operator(
    "s_19_locked_problems",
    lambda d: "WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'number of the source missing' WHEN 1 THEN 'fewer sentences' WHEN 2 THEN 'marks differ; missing <a1>' WHEN 3 THEN 'marks differ; missing <i2>' WHEN 4 THEN 'glossary: term' ELSE 'style' END AS problem FROM events) "
    + f"SELECT event_id, problem, {d.has('problem', 'number of the source|fewer sentences|refusal|invented|empty|glossary:')} OR ({d.contains('problem', repr('marks differ'))} AND {d.has('problem', '</?a[0-9]|<n[0-9]')}) AS locked FROM p",
)
# S-20: risk: common verb with a particle, emphasis or exclamation, short quoted speech.
# S-23: words that look like old spelling; capitalised ones are names.
operator(
    "s_23_antique_leftovers",
    lambda d: f"SELECT doc_id, {d.join(d.distinct(d.keep(d.all('text', spelling.WORD), 'w', f"{d.has('w', spelling.ANTIQUE)} AND NOT {d.has('w', '^[A-ZÀ-ÖØ-Þ]')}")), ',')} AS leftovers FROM documents WHERE text IS NOT NULL",
)
def escaped(d, x: str) -> str:
    for c in "\\`*_{}[]<>#$@^~|":
        x = f"replace({x}, {d.lit(c)}, {d.lit(chr(92) + c)})"
    return x


operator("s_25_md_escape", lambda d: with_(lines(d)) + f"SELECT doc_id, ord, {escaped(d, 'line')} AS escaped FROM lines")
# S-27: votes of a judge, a line each; the first vote of an item counts, items without one are upheld.
operator(
    "s_27_votes",
    lambda d: f"""WITH t AS (SELECT conv_id, concat('1: a | b | FIEL', chr(10), CAST(conv_id % 4 + 1 AS STRING), ': a | b | ERRO', chr(10), 'x', chr(10), '2. FIEL') AS txt FROM conversations WHERE turn = 0),
    l AS ({d.explode('t', 'conv_id', d.split('txt', chr(10)), 'i', 'line')}),
    v AS (SELECT conv_id, i, {d.first('line', '^[ ]*([0-9]+)[:.)]', 1)} AS k, {d.first('line', '(FIEL|ERRO)', 1)} AS vote FROM l),
    f AS (SELECT conv_id, k, vote, row_number() OVER (PARTITION BY conv_id, k ORDER BY i) AS nth FROM v WHERE k <> '' AND vote <> ''),
    want AS (SELECT t.conv_id, q.k FROM t CROSS JOIN (VALUES ('1'), ('2'), ('3')) AS q(k))
    SELECT w.conv_id, w.k, coalesce(f.vote = 'ERRO', true) AS upheld FROM want w LEFT JOIN f ON f.conv_id = w.conv_id AND f.k = w.k AND f.nth = 1""",
)
# S-28: certainty: probability of the chosen word by that of both, from log probabilities.
operator("s_28_certainty", lambda d: "WITH p AS (SELECT event_id, -value / 50 AS a, -(event_id % 17) / 5.0E0 AS b FROM events) SELECT event_id, round(exp(a) / (exp(a) + exp(b)), 3) AS certainty FROM p")
operator("s_29_context_budget", lambda d: with_(pairs(d)) + "SELECT conv_id, turn, CAST(length(src) + length(out) AS DOUBLE) * 20 / 3 + greatest(2000, 0) + 300 <= 8192 AS fits FROM pairs")
operator("s_30_answer_cap", lambda d: "SELECT doc_id, CASE WHEN length(text) > 300 THEN greatest(2000, CAST(floor(length(text) * 0.6) AS BIGINT)) ELSE greatest(80, CAST(length(text) AS BIGINT)) END AS cap FROM documents WHERE text IS NOT NULL")
# S-31: the first of a role's preferences that is installed; if none is, the first of all. An auditor without an installed translator has other ones.
PREFERENCES = {"translator": ("fast", "large", "light"), "general": ("light", "large"), "auditor": ("light", "second"), "reader": ("light", "large", "second"), "reader2": ("ocr", "second", "large", "light"), "judge": ("large", "second", "light")}
MODELS = ("fast", "large", "second", "light", "ocr")


def preferred(d, names: tuple[str, ...]) -> str:
    wanted = d.array(*map(d.lit, names))
    return f"coalesce({d.at(d.keep(wanted, 'x', d.within('have', 'x')), '1')}, {d.lit(names[0])})"


operator(
    "s_31_model_default",
    lambda d: f"""WITH h AS (SELECT c_custkey, {d.keep(d.array(*map(d.lit, MODELS)), 'm', 'CAST(floor(c_custkey / CASE m ' + ' '.join(f"WHEN '{m}' THEN {2**k}" for k, m in enumerate(MODELS)) + ' END) AS BIGINT) % 2 = 1')} AS have FROM customer),
    r AS (SELECT c_custkey, have, role FROM h CROSS JOIN (VALUES {', '.join(f"('{r}')" for r in PREFERENCES)}) AS q(role))
    SELECT c_custkey, role, CASE WHEN role = 'auditor' AND NOT {d.within('have', "'fast'")} THEN {preferred(d, ("second", "light"))} {' '.join(f"WHEN role = '{k}' THEN {preferred(d, v)}" for k, v in PREFERENCES.items())} END AS model FROM r""",
)
operator("s_32_provenance", lambda d: with_(draft(d)) + "SELECT doc_id, CASE WHEN kind = 'image' THEN 'image' WHEN edited IS NOT NULL AND edited <> '' THEN 'edited by hand' WHEN status = 'judge' THEN 'corrected by the judge' WHEN automatic THEN 'accepted automatically' ELSE 'as proposed' END AS path FROM draft")
operator("s_33_final_text", lambda d: with_(draft(d)) + "SELECT doc_id, coalesce(nullif(edited, ''), nullif(result, ''), '') AS final FROM draft")
operator("s_34_sha256", lambda d: f"SELECT doc_id, {d.sha('''coalesce(text, '')''')} AS sha FROM documents")
operator("s_35_last_version", lambda d: with_(items(d)) + "SELECT job, k, coalesce(judged, revised, proposal) AS version FROM items")
operator(
    "s_36_effective_problems",
    lambda d: with_(items(d)) + f"""SELECT job, k, {d.join(d.keep(d.split("CASE WHEN judged IS NOT NULL THEN 'judge' WHEN revised IS NOT NULL THEN concat(checks2, '|style: x') ELSE concat(coalesce(checks, '[]'), '|style: y') END", '|'), 'x', "NOT x LIKE 'style: %'"), '; ')} AS problems FROM items""",
)
operator("s_37_citation", lambda d: "SELECT c_custkey, concat(c_name, ', ', c_mktsegment, ', p. ', CAST(c_custkey % 300 + 1 AS STRING), '.') AS simple, concat(upper(c_name), '. ', c_mktsegment, '. p. ', CAST(c_custkey % 300 + 1 AS STRING), '.') AS formal FROM customer")
operator("s_38_url_allowed", lambda d: f"SELECT page_id, url, {d.has('url', '^https://([^/?#]*[.])?(example[.]com|example[.]org)(/|[?#]|$)')} AS allowed FROM pages")
operator("s_39_next_clock", lambda d: f"WITH e AS (SELECT event_id, {d.epoch('ts')} AS t, (event_id % 24) * 3600 + (event_id % 60) * 60 AS clock FROM events) SELECT event_id, CAST(CASE WHEN t - t % 86400 + clock > t THEN t - t % 86400 + clock ELSE t - t % 86400 + clock + 86400 END AS BIGINT) AS following FROM e")
operator(
    "s_40_title_rewrite",
    lambda d: f"""WITH f AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'kept' END AS original, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE concat('New ', c_name) END AS title FROM customer)
    SELECT c_custkey, title, CASE WHEN title = coalesce(original, c_name) THEN NULL ELSE coalesce(original, c_name) END AS original_title FROM f""",
)
# S-41: title and author from a file's name, "Title (Author)"; an author "Last, First" is turned round.
operator(
    "s_41_filename_guess",
    lambda d: f"""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_name ELSE concat(p_name, ' (', CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, ', Ana') WHEN 1 THEN p_brand ELSE concat(p_brand, ', Ana, jr') END, ')') END AS file FROM part),
    a AS (SELECT p_partkey, CASE WHEN {d.has('file', '^.*[(][^)]*[)]$')} THEN trim({d.first('file', '^(.*)[(][^)]*[)]$', 1)}) ELSE file END AS title, {d.first('file', '[(]([^)]*)[)]$', 1)} AS author FROM n)
    SELECT p_partkey, title, CASE WHEN {d.has('author', '^[^,]+, [^,]+$')} THEN concat({d.first('author', ', ([^,]+)$', 1)}, ' ', {d.first('author', '^([^,]+),', 1)}) ELSE author END AS author FROM a""",
)
# S-42: deep merge of nested settings, as leaves by path: the new value of a leaf wins, other leaves of its section stay, new leaves come in.
operator(
    "s_42_config_merge",
    lambda d: """WITH base AS (SELECT * FROM (VALUES ('roles.translator', ''), ('roles.reader', 'auto'), ('net.search', 'false'), ('net.editions', 'false'), ('process.judge', 'true')) AS b(path, value)),
    given AS (SELECT c_custkey, 'net.search' AS path, CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS value FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, concat('roles.', lower(c_mktsegment)), c_name FROM customer WHERE c_custkey % 2 = 0),
    whole AS (SELECT c.c_custkey, b.path, b.value FROM customer c CROSS JOIN base b)
    SELECT coalesce(w.c_custkey, g.c_custkey) AS c_custkey, coalesce(w.path, g.path) AS path, coalesce(g.value, w.value) AS value FROM whole w FULL OUTER JOIN given g ON w.c_custkey = g.c_custkey AND w.path = g.path""",
)
# S-43: an imported file's extension must be known and its first bytes must fit it; text must not be binary. Files here: pages under other names.
operator(
    "s_43_import_validation",
    lambda d: """WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'html' WHEN 3 THEN 'txt' WHEN 4 THEN 'exe' ELSE 'md' END AS ext,
      concat(CASE page_id % 7 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN concat('PK', chr(3), chr(4)) WHEN 2 THEN concat('x', chr(1)) ELSE '' END, coalesce(html, '')) AS content FROM pages)
    SELECT page_id, ext, ext IN ('pdf', 'epub', 'html', 'htm', 'txt', 'md', 'fb2', 'mobi', 'azw3', 'docx', 'odt') AS known,
      CASE ext WHEN 'pdf' THEN substring(content, 1, 4) = '%PDF' WHEN 'epub' THEN substring(content, 1, 4) = concat('PK', chr(3), chr(4)) ELSE strpos(substring(content, 1, 1000), chr(1)) = 0 END AS fits FROM f""".replace("strpos(", "instr("),
)
# S-44: the kind of a book by its language and whether its spelling is old, and the task of the kind. Spanish texts stand for Portuguese ones here.
operator(
    "s_44_task_choice",
    lambda d: """WITH g AS (SELECT doc_id, CASE lang WHEN 'es' THEN 'pt' ELSE lang END AS language, doc_id % 3 = 0 AS old FROM documents),
    k AS (SELECT doc_id, language, CASE WHEN language IS NULL OR language NOT IN ('en', 'de', 'pt') THEN '' WHEN language <> 'pt' THEN 'translation' WHEN old THEN 'update' ELSE 'native' END AS kind FROM g)
    SELECT doc_id, kind, CASE WHEN kind = 'update' THEN 'modernise' WHEN kind = 'native' THEN 'none' WHEN language = 'en' THEN 'translate' WHEN language = 'de' THEN 'translate_de' ELSE 'none' END AS task FROM k""",
)
operator("s_45_partial_json", lambda d: f"""WITH t AS (SELECT event_id, substring('{{"fidelity": [{{"passage": "ab", "problem": "cd"}}, {{"passage": "ef", "problem": "gh"}}]}}', 1, CAST(10 + event_id % 80 AS INT)) AS t FROM events) SELECT event_id, {d.n('t', '"passage": "[^"]*", "problem": "[^"]*"')} AS seen, CASE WHEN {d.has('t', r'"fidelity": \[')} THEN 'speaking' ELSE 'reading' END AS state FROM t""")
operator(
    "s_46_contrast",
    lambda d: "WITH c AS (SELECT p_partkey, CAST(p_partkey % 256 AS DOUBLE) / 255 AS a, CAST(p_size * 5 % 256 AS DOUBLE) / 255 AS b FROM part), l AS (SELECT p_partkey, CASE WHEN a <= 0.03928 THEN a / 12.92 ELSE power((a + 0.055) / 1.055, 2.4) END AS x, CASE WHEN b <= 0.03928 THEN b / 12.92 ELSE power((b + 0.055) / 1.055, 2.4) END AS y FROM c) SELECT p_partkey, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) AS contrast FROM l",
)
operator("s_47_fits_gpu", lambda d: "SELECT p_partkey, p_retailprice / 90 * 1.15 <= 12 AS fits FROM part")
# Names of fonts, and the free family that stands for them; the first that fits.
FONTS = (
    ("times|roman|liberation serif|nimbus rom|georgia|cambria", "Termes"),
    ("palatino|pagella|book antiqua|garamond|minion|caslon|sabon|bembo|baskerville|goudy|jenson", "Pagella"),
    ("century|schoolbook", "Schola"),
    ("bookman", "Bonum"),
    ("helvetica|arial|calibri|verdana|sans|univers|frutiger|gothic", "Heros"),
)
NAMES = ("Times New Roman", "Adobe Garamond Pro", "New Century", "ITC Bookman", "Frutiger LT", "Comic Script", "Gothic Roman", "Sans Bookman")
# S-48: the name in a part's row is one of NAMES with the part's own name after it.
operator(
    "s_48_font_equivalents",
    lambda d: "WITH n AS (SELECT p_partkey, concat(CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {d.lit(x)}" for k, x in enumerate(NAMES)) + " END, ' ', p_name) AS font FROM part) SELECT p_partkey, font, CASE "
    + " ".join(f"WHEN {d.has('lower(font)', p)} THEN {d.lit('TeX Gyre ' + f)}" for p, f in FONTS) + " END AS family FROM n",
)
