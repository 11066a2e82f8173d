"""Joins, aggregations, sorts and set operations (JOIN, AGG, SRT, SET)."""

from quillspark.functions import lexicons
from quillspark.plans.dialect import blocks, draft, items, lines, operator, oracle, page_lines, pairs, roman, with_

# --- joins ---
operator(
    "join_01_draft",
    lambda d: with_(blocks(d), items(d)) + """, was AS (SELECT doc_id, id, CASE WHEN ord % 3 = 0 THEN text ELSE concat(text, ' ') END AS result, ord % 2 = 0 AS accepted FROM blocks WHERE ord % 4 <> 1)
    SELECT b.doc_id, b.id, b.kind, CASE WHEN i.job IS NULL THEN b.text ELSE coalesce(i.judged, i.revised, i.proposal) END AS result,
      CASE WHEN i.job IS NULL THEN 'approved' WHEN i.state IN ('approved', 'review') THEN i.state ELSE 'running' END AS status,
      coalesce(w.accepted, false) AND w.result = CASE WHEN i.job IS NULL THEN b.text ELSE coalesce(i.judged, i.revised, i.proposal) END AS accepted
    FROM blocks b LEFT JOIN items i ON i.job = b.doc_id AND i.k = b.ord LEFT JOIN was w ON w.doc_id = b.doc_id AND w.id = b.id""",
)
operator(
    "join_02_proof",
    lambda d: with_(draft(d)) + f"SELECT r.doc_id, {d.sha('''coalesce(d.text, '')''')} AS source_sha, {d.sha('''coalesce(nullif(r.edited, ''), r.result, '')''')} AS result_sha, r.accepted FROM draft r LEFT JOIN documents d ON d.doc_id = r.doc_id",
)
# JOIN-03: as-of, forward: the first commit at or after an accept; union and window, one shuffle by key.
operator(
    "join_03_asof_commit",
    lambda d: f"""WITH e AS (SELECT user_id, event_id, {d.epoch('ts')} AS moment, event_type FROM events WHERE event_type IN ('view', 'click')),
    w AS (SELECT user_id, event_id, moment, event_type, min(CASE WHEN event_type = 'click' THEN moment END) OVER (PARTITION BY user_id ORDER BY moment RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS commit_at FROM e)
    SELECT user_id, event_id, moment, commit_at FROM w WHERE event_type = 'view'""",
)
operator(
    "join_04_consistency",
    lambda d: with_(draft(d)) + """, b AS (SELECT book, doc_id FROM draft WHERE accepted), s AS (SELECT source AS book, doc_id FROM documents WHERE doc_id % 2 = 0),
    j AS (SELECT coalesce(b.book, s.book) AS book, b.doc_id IS NOT NULL AS here, s.doc_id IS NOT NULL AS there FROM b FULL OUTER JOIN s ON b.doc_id = s.doc_id AND b.book = s.book)
    SELECT book, CAST(sum(CASE WHEN here THEN 1 ELSE 0 END) AS BIGINT) AS here, CAST(sum(CASE WHEN there THEN 1 ELSE 0 END) AS BIGINT) AS there, min(CASE WHEN here AND there THEN 1 ELSE 0 END) = 1 AS closes FROM j GROUP BY book""",
)
operator(
    "join_05_bilingual",
    lambda d: with_(draft(d)) + "SELECT s.doc_id, s.text AS source_text, CASE WHEN r.kind = 'image' THEN '' WHEN r.accepted THEN coalesce(nullif(r.edited, ''), r.result) ELSE '(not accepted)' END AS target_text FROM documents s LEFT JOIN draft r ON r.doc_id = s.doc_id",
)
operator(
    "join_06_parallel_view",
    lambda d: with_(blocks(d)) + """, a AS (SELECT doc_id, text, CASE WHEN kind = 'heading' THEN concat('h', CAST(page AS STRING)) ELSE concat('p', CAST(ord AS STRING)) END AS k FROM blocks),
    b AS (SELECT doc_id, lower(text) AS reviewed, CASE WHEN kind = 'heading' THEN concat('h', CAST(page AS STRING)) ELSE concat('p', CAST(ord AS STRING)) END AS k FROM blocks WHERE ord % 3 <> 1)
    SELECT a.doc_id, a.k, a.text, b.reviewed FROM a JOIN b ON a.doc_id = b.doc_id AND a.k = b.k""",
)
operator(
    "join_08_positional_zip",
    lambda d: with_(pairs(d)) + f""", s AS ({d.explode('pairs', 'conv_id, turn', d.split('src', '. '), 'i', 'x')}), o AS ({d.explode('pairs', 'conv_id, turn', d.split('out', '. '), 'i', 'y')})
    SELECT s.conv_id, s.turn, s.i, CAST(length(s.x) AS BIGINT) AS source_len, CAST(length(o.y) AS BIGINT) AS out_len FROM s JOIN o ON s.conv_id = o.conv_id AND s.turn = o.turn AND s.i = o.i""",
)
# JOIN-09: four-gram index probe: where a passage's four-grams occur in texts, first of all and at or after a place.
def four_grams(d, table: str, key: str, name: str) -> str:
    words = d.split("trim(lower(" + d.rx("coalesce(text, '')", "[ \t\n]+", " ") + "))", " ")
    each = d.explode(f"{name}_words", key, "ws", "p", "x")
    run = "concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v) AS g, lead(x, 3) OVER v AS fourth"
    return f"{name}_words AS (SELECT {key}, {words} AS ws FROM {table}), {name}_each AS ({each}), {name}_runs AS (SELECT {key}, p, {run} FROM {name}_each WINDOW v AS (PARTITION BY {key} ORDER BY p)), {name} AS (SELECT {key}, p, g FROM {name}_runs WHERE fourth IS NOT NULL)"


operator(
    "join_09_four_gram_probe",
    lambda d: with_(four_grams(d, "benchmark", "item_id", "q"), four_grams(d, "documents", "doc_id", "s")) + """, w AS (SELECT DISTINCT item_id, g FROM q)
    SELECT w.item_id, s.doc_id, min(s.p) AS first_place, min(CASE WHEN s.p >= 100 THEN s.p END) AS first_after, CAST(count(*) AS BIGINT) AS places, CAST(count(DISTINCT s.g) AS BIGINT) AS grams FROM w JOIN s ON w.g = s.g GROUP BY w.item_id, s.doc_id""",
)
# JOIN-12: a mark moves to its own line if that still holds its snippet, else to the first that does, else nowhere.
oracle(
    "join_12_relocate_marks",
    lambda d: with_(lines(d)) + f""", m AS (SELECT doc_id, ord, substring(trim(line), 1, 12) AS snippet FROM lines WHERE ord % 7 = 3 AND length(trim(line)) >= 12),
    now AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 1 THEN substring(line, 9) ELSE line END AS line FROM lines),
    hit AS (SELECT m.doc_id, m.ord AS was, n.ord AS ord, CAST(row_number() OVER (PARTITION BY m.doc_id, m.ord ORDER BY CASE WHEN n.ord = m.ord THEN 0 ELSE 1 END, n.ord) AS BIGINT) AS rank FROM m JOIN now n ON m.doc_id = n.doc_id AND {d.contains('n.line', 'm.snippet')})
    SELECT m.doc_id, m.ord AS was, h.ord AS moved FROM m LEFT JOIN hit h ON m.doc_id = h.doc_id AND m.ord = h.was AND h.rank = 1""",
)
# JOIN-13: rows without a partner, and whether the others' partners are all ignored. Customers without dear orders.
operator(
    "join_13_anti_semi",
    lambda d: f"""WITH o AS (SELECT o_custkey, o_orderkey % 5 = 0 AS ignored FROM orders WHERE o_orderkey % 3 = 0),
    a AS (SELECT c_custkey, c_name FROM customer c {'LEFT ANTI' if d.name == 'spark' else 'ANTI'} JOIN o ON o.o_custkey = c.c_custkey),
    s AS (SELECT c_custkey, c_name FROM customer c {'LEFT SEMI' if d.name == 'spark' else 'SEMI'} JOIN (SELECT * FROM o WHERE NOT ignored) k ON k.o_custkey = c.c_custkey)
    SELECT c_custkey, lower(c_name) AS name, 'none' AS has FROM a UNION ALL SELECT c_custkey, lower(c_name), 'some' FROM s""",
)
operator(
    "join_15_copies_in_review",
    lambda d: with_(blocks(d)) + """, diffs AS (SELECT doc_id, id, ord % 4 AS copy, CAST(length(text) AS BIGINT) AS changes FROM blocks WHERE ord % 4 < 2), copies AS (SELECT * FROM (VALUES (0), (1)) AS c(copy))
    SELECT b.doc_id, b.id, c.copy, CASE WHEN f.id IS NULL THEN 'absent' ELSE 'different' END AS outcome, f.changes FROM blocks b CROSS JOIN copies c LEFT JOIN diffs f ON f.doc_id = b.doc_id AND f.id = b.id AND f.copy = c.copy""",
)
MARK_CASE = """CASE WHEN proposal IS NULL THEN 'waiting' WHEN audit_ok IS NULL THEN 'proposed' WHEN audit_ok = 1 AND coalesce(checks, '') IN ('', '[]') THEN 'checked' WHEN audit2_ok IS NULL THEN 'objection'
  WHEN audit2_ok = 1 AND coalesce(checks2, '') IN ('', '[]') THEN 'checked' WHEN judged IS NOT NULL AND judged <> '' THEN 'judge' WHEN (verdict IS NOT NULL AND verdict <> '') OR state IN ('approved', 'review') THEN CASE WHEN state = 'approved' THEN 'checked' ELSE 'you' END ELSE 'dispute' END"""
operator(
    "join_16_live_view",
    lambda d: with_(blocks(d), items(d)) + f", m AS (SELECT job, k, {MARK_CASE} AS mark FROM items) SELECT b.doc_id, b.id, b.page, coalesce(m.mark, 'waiting') AS mark FROM blocks b LEFT JOIN m ON m.job = b.doc_id AND m.k = b.ord",
)

# --- aggregations ---
operator(
    "agg_01_job_summary",
    lambda d: with_(items(d)) + """, c AS (SELECT job, CAST(count(*) AS BIGINT) AS total, CAST(count(proposal) AS BIGINT) AS proposed, CAST(count(audit_ok) AS BIGINT) AS checked,
      CAST(sum(CASE WHEN audit_ok IS NOT NULL AND (audit_ok = 0 OR coalesce(checks, '') NOT IN ('', '[]')) THEN 1 ELSE 0 END) AS BIGINT) AS with_problem, CAST(count(revised) AS BIGINT) AS corrected, CAST(count(audit2_ok) AS BIGINT) AS rechecked,
      CAST(sum(CASE WHEN audit2_ok IS NOT NULL AND (audit2_ok = 0 OR coalesce(checks2, '') NOT IN ('', '[]')) THEN 1 ELSE 0 END) AS BIGINT) AS in_dispute,
      CAST(sum(CASE WHEN verdict LIKE '%"winner": "translator"%' THEN 1 ELSE 0 END) AS BIGINT) AS won_translator, CAST(sum(CASE WHEN verdict LIKE '%"winner": "auditor"%' THEN 1 ELSE 0 END) AS BIGINT) AS won_auditor,
      CAST(sum(CASE WHEN verdict LIKE '%"winner": "user"%' THEN 1 ELSE 0 END) AS BIGINT) AS won_user, min(CASE WHEN state = 'approved' THEN 1 ELSE 0 END) = 1 AS done FROM items GROUP BY job)
    SELECT job, total, proposed, checked, with_problem, corrected, rechecked, in_dispute, won_translator, won_auditor, won_user,
      CASE WHEN done THEN CAST(1.0 AS DOUBLE) ELSE round(CAST(proposed + checked + corrected + rechecked AS DOUBLE) / greatest(1, 2 * total + 2 * with_problem), 3) END AS progress FROM c""",
)
operator("agg_02_draft_counters", lambda d: with_(draft(d)) + "SELECT book, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN status = 'review' THEN 1 ELSE 0 END) AS BIGINT) AS review, CAST(sum(CASE WHEN status = 'judge' THEN 1 ELSE 0 END) AS BIGINT) AS judge FROM draft GROUP BY book")
operator("agg_03_vocabulary", lambda d: f"WITH w AS ({d.explode('documents', 'doc_id', d.all('lower(text)', '[a-zß-öø-ÿ]+'), 'i', 'word')}) SELECT word, CAST(count(*) AS BIGINT) AS times FROM w GROUP BY word")
operator(
    "agg_04_dominant_size",
    lambda d: """WITH s AS (SELECT l_orderkey AS book, CAST(round(l_quantity, 0) AS BIGINT) AS size, CAST(sum(l_linenumber) AS BIGINT) AS chars FROM lineitem GROUP BY l_orderkey, CAST(round(l_quantity, 0) AS BIGINT)),
    r AS (SELECT book, size, chars, row_number() OVER (PARTITION BY book ORDER BY chars DESC, size) AS k FROM s) SELECT book, size, chars FROM r WHERE k = 1""",
)
# AGG-05: running heads: short lines among a page's first two or its last whose letters recur on a fifth of the book's pages (two at least).
operator(
    "agg_05_running_heads",
    lambda d: with_(page_lines(d)) + f""", e AS (SELECT DISTINCT source, doc_id, {d.rx(d.fold('line'), '[^a-z]+')} AS k FROM page_lines WHERE (up <= 2 OR down = 1) AND length(line) < 60 AND line NOT LIKE '![%'),
    p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM page_lines GROUP BY source)
    SELECT e.source, e.k, CAST(count(*) AS BIGINT) AS pages FROM e JOIN p ON e.source = p.source WHERE e.k <> '' GROUP BY e.source, e.k, p.pages HAVING count(*) >= greatest(2, 0.2 * p.pages)""",
)
# Frequent words by which a page's language is voted, in the order that wins ties.
VOTES = {
    "pt": "de que não uma para com os das dos como mais".split(),
    "en": "the of and to that is in it for with".split(),
    "de": "der die und das ist nicht den von zu mit".split(),
}
# Frequent words by which a book's language is guessed, in the order that wins ties.
GUESSES = {
    "en": lexicons.COMMON["en"],
    "de": lexicons.COMMON["de"],
    "pt": lexicons.COMMON["pt"] + "são também pelo isso foi já seu sua mas".split(),
    "es": "el los las y del en es lo su al muy pero más como una que de la se por con no".split(),
    "fr": "le la les des et est un une dans pour qui pas je il ne au du sur avec ce que de se".split(),
    "it": "il di che per non gli della sono una nel più con le del la un si da in è".split(),
}


def first_most(names: list[str]) -> str:
    """The name of the largest column; of equal ones the first."""
    return "CASE " + " ".join(f"WHEN {n} = greatest({', '.join(names)}) THEN '{n}'" for n in names) + " END"


def vote_spark(d) -> str:
    """One pass over the words: of equal words in a row every second counts, as each match takes the space that the next one needs."""
    counts = "x <> a.last OR NOT a.odd"
    start = "named_struct('last', '', 'odd', false, " + ", ".join(f"'{k}', 0L" for k in VOTES) + ")"
    step = f"named_struct('last', x, 'odd', {counts}, " + ", ".join(f"'{k}', a.{k} + CASE WHEN ({counts}) AND x IN ({', '.join(map(d.lit, w))}) THEN 1L ELSE 0L END" for k, w in VOTES.items()) + ")"
    return f"""WITH w AS (SELECT doc_id, split(trim({d.rx("lower(coalesce(text, ''))", "[ \t\n\r]+", " ")}), ' ') AS w FROM documents),
    v AS (SELECT doc_id, aggregate(w, {start}, (a, x) -> {step}) AS v FROM w)
    SELECT doc_id, {', '.join(f'v.{k} AS {k}' for k in VOTES)} FROM v"""


def vote_duck(d) -> str:
    times = lambda w: f"(length(t) - length(replace(t, {d.lit(f' {w} ')}, ''))) / {len(w) + 2}"
    return f"""WITH t AS (SELECT doc_id, concat(' ', trim({d.rx("lower(coalesce(text, ''))", "[ \t\n\r]+", " ")}), ' ') AS t FROM documents)
    SELECT doc_id, {', '.join(f"CAST({' + '.join(map(times, words))} AS BIGINT) AS {k}" for k, words in VOTES.items())} FROM t"""


# AGG-07: stop words between single spaces, counted as substrings that do not overlap; the first language wins ties.
operator("agg_07_language_vote", lambda d: f"SELECT *, {first_most(list(VOTES))} AS voted FROM ({vote_spark(d) if d.name == 'spark' else vote_duck(d)}) q")
# AGG-08: words of six languages; a text of 200 words or fewer keeps what its metadata say.
operator(
    "agg_08_language_guess",
    lambda d: f"""WITH t AS (SELECT doc_id, lang, {d.all("lower(coalesce(text, ''))", '[a-zà-ÿ]+')} AS w FROM documents),
    v AS (SELECT doc_id, lang, {d.size('w')} AS tokens, {', '.join(d.size(d.keep('w', 'x', f"x IN ({', '.join(map(d.lit, words))})")) + f' AS {k}' for k, words in GUESSES.items())} FROM t)
    SELECT doc_id, tokens, CASE WHEN tokens <= 200 THEN lower(substring(lang, 1, 2)) ELSE {first_most(list(GUESSES))} END AS guessed FROM v""",
)
operator(
    "agg_09_majority_language",
    lambda d: "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c) SELECT d.doc_id, d.source, d.lang FROM documents d JOIN r ON r.source = d.source AND r.lang = d.lang WHERE r.k = 1",
)
# AGG-10: layer quality over an odd stride of pages: share in another language, upper median of a rate, share of bad pages.
operator(
    "agg_10_layer_quality",
    lambda d: """WITH p AS (SELECT source, doc_id, lang, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS pages FROM documents WHERE length(text) > 200),
    s AS (SELECT *, CASE WHEN floor(greatest(1, floor(pages / 30))) % 2 = 0 THEN greatest(1, floor(pages / 30)) + 1 ELSE greatest(1, floor(pages / 30)) END AS stride FROM p),
    m AS (SELECT source, lang, CAST(n % 100 AS DOUBLE) / 1000 AS rate FROM s WHERE i % stride = 0 AND i / stride < 30),
    r AS (SELECT source, lang, rate, row_number() OVER (PARTITION BY source ORDER BY rate) AS k, count(*) OVER (PARTITION BY source) AS c FROM m)
    SELECT source, CAST(count(*) AS BIGINT) AS sampled, round(CAST(sum(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS other_language, max(CASE WHEN k = floor(c / 2) + 1 THEN rate END) AS upper_median, round(CAST(sum(CASE WHEN rate > 0.08 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS bad FROM r GROUP BY source""",
)
# AGG-13: summary of a compared copy: blocks by outcome, and what only the copy has. Blocks and copies pair by number here; blocks of under six
# words are not compared, the copy lacks every seventh block, changes every fifth, and has a line of its own in every book of even number.
operator(
    "agg_13_copy_summary",
    lambda d: with_(blocks(d)) + f""", c AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 2 THEN concat(text, ' more') ELSE text END AS text FROM blocks WHERE ord % 7 <> 3 UNION ALL SELECT DISTINCT doc_id, CAST(100000 AS BIGINT), 'only here' FROM blocks WHERE doc_id % 2 = 0),
    o AS (SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, CASE WHEN b.ord IS NULL THEN 'only in copy' WHEN {d.size(d.all('b.text', '[^ ]+'))} < 6 THEN 'not compared' WHEN c.ord IS NULL THEN 'absent' WHEN b.text = c.text THEN 'equal' ELSE 'different' END AS outcome, {d.size(d.all("coalesce(c.text, '')", '[^ ]+'))} AS words FROM blocks b FULL OUTER JOIN c ON b.doc_id = c.doc_id AND b.ord = c.ord)
    SELECT doc_id, CAST(sum(CASE WHEN outcome <> 'only in copy' THEN 1 ELSE 0 END) AS BIGINT) AS blocks, CAST(sum(CASE WHEN outcome NOT IN ('only in copy', 'not compared') THEN 1 ELSE 0 END) AS BIGINT) AS compared, {', '.join(f"CAST(sum(CASE WHEN outcome = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k.replace(' ', '_')}" for k in ('not compared', 'equal', 'different', 'absent', 'only in copy'))}, CAST(sum(words) AS BIGINT) AS words_of_copy
    FROM o GROUP BY doc_id""",
)
operator(
    "agg_14_proof_totals",
    lambda d: with_(draft(d)) + "SELECT book, CAST(count(*) AS BIGINT) AS source, CAST(count(result) AS BIGINT) AS draft, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN accepted AND automatic THEN 1 ELSE 0 END) AS BIGINT) AS no_record, sum(CASE WHEN accepted THEN 0 ELSE 1 END) = 0 AS closes FROM draft GROUP BY book",
)
operator(
    "agg_15_time_estimate",
    lambda d: with_(items(d)) + ", j AS (SELECT job, sum(seconds) AS seconds, count(*) AS blocks, min(CASE WHEN state = 'approved' THEN 1 ELSE 0 END) AS done FROM items GROUP BY job), m AS (SELECT CAST(sum(CASE WHEN done = 1 THEN seconds END) AS DOUBLE) AS s, CAST(sum(CASE WHEN done = 1 THEN blocks END) AS DOUBLE) AS b FROM j) SELECT j.job, j.blocks, CASE WHEN m.b > 0 THEN m.s / m.b * j.blocks END AS estimate FROM j CROSS JOIN m",
)
# AGG-17: marks of two texts as multisets: how many of each are missing, how many too many, and whether all agree. The other text lacks every third mark,
# and has every fifth twice.
operator(
    "agg_17_multiset_difference",
    lambda d: f"""WITH s AS ({d.explode('documents', 'doc_id', d.all("coalesce(text, '')", '[#*$%&]{3}'), 'i', 'mark')}), a AS (SELECT doc_id, mark, count(*) AS n FROM s GROUP BY doc_id, mark),
    b AS (SELECT doc_id, mark, sum(CASE WHEN i % 5 = 0 AND doc_id % 7 <> 2 THEN 2 ELSE 1 END) AS n FROM s WHERE doc_id % 7 = 2 OR i % 3 > 0 GROUP BY doc_id, mark),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.mark, b.mark) AS mark, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.mark = b.mark)
    SELECT doc_id, mark, CAST(greatest(x - y, 0) AS BIGINT) AS missing, CAST(greatest(y - x, 0) AS BIGINT) AS extra, min(CASE WHEN x = y THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 1 AS equal FROM j""",
)
operator("agg_18_correlated_count", lambda d: "SELECT o.o_orderkey, o.o_orderdate, (SELECT CAST(count(*) AS BIGINT) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS items FROM orders o ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 20")
operator(
    "agg_19_chapters",
    lambda d: with_(blocks(d)) + ", c AS (SELECT doc_id, ord, CAST(sum(CASE WHEN ord % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chapter FROM blocks) SELECT doc_id, chapter, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(count(*)) OVER (PARTITION BY doc_id ORDER BY chapter) - count(*) AS BIGINT) AS start FROM c GROUP BY doc_id, chapter",
)
operator(
    "agg_20_piles",
    lambda d: with_(items(d)) + f", m AS (SELECT job, {MARK_CASE} AS mark FROM items) SELECT job, {', '.join(f'''CAST(sum(CASE WHEN mark = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}''' for k in ('proposed', 'checked', 'objection', 'dispute', 'judge', 'you'))}, CAST(sum(CASE WHEN mark <> 'waiting' THEN 1 ELSE 0 END) AS BIGINT) AS proposals FROM m GROUP BY job",
)

# --- sorts and sets ---
operator("srt_01_risk_order", lambda d: f"SELECT doc_id, {d.n('text', '!')} AS risk, CAST(row_number() OVER (PARTITION BY source ORDER BY {d.n('text', '!')} DESC, doc_id) AS BIGINT) AS place FROM documents WHERE text IS NOT NULL")
operator("srt_02_revise_order", lambda d: with_(items(d)) + "SELECT job, k, CAST(row_number() OVER (PARTITION BY job ORDER BY CASE WHEN checks LIKE '%size%' THEN 1 ELSE 0 END, k) AS BIGINT) AS place FROM items")
operator("srt_03_top_k", lambda d: "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
operator("srt_04_newest_first", lambda d: "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place FROM orders")
NUMBERS = "[0-9]+"
# SET-01: numbers of the source that the output lacks, also as Roman numerals. Numbers here: the conversation's and the turn's, of which the output
# of every third conversation lacks the first, and that of every fifth has it in Roman numerals.
operator(
    "set_01_missing_numbers",
    lambda d: with_(pairs(d)) + f""", n AS (SELECT conv_id, turn, src, out, CAST(conv_id % 60 + 1 AS BIGINT) AS a FROM pairs),
    m AS (SELECT conv_id, turn, concat(src, ' ', CAST(a AS STRING), ' and ', CAST(turn + 100 AS STRING)) AS src, concat(out, ' ', CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 5 = 0 THEN {roman(d, 'a')} ELSE CAST(a AS STRING) END, ' and ', CAST(turn + 100 AS STRING)) AS out FROM n),
    g AS (SELECT conv_id, turn, out, {d.without(d.distinct(d.all('src', NUMBERS)), d.distinct(d.all('out', NUMBERS)))} AS gone FROM m)
    SELECT conv_id, turn, {d.join(d.keep('gone', 'x', f"NOT {d.contains('out', 'concat(' + repr(' ') + ', ' + roman(d, 'CAST(x AS BIGINT)') + ', ' + repr(' ') + ')')}"), ',')} AS missing FROM g""",
)
operator("set_02_returned_words", lambda d: with_(pairs(d)) + f"SELECT conv_id, turn, {d.join(d.both(d.distinct(d.all('src', '[a-zß-öø-ÿ]{5,}')), d.distinct(d.all('out', '[a-zß-öø-ÿ]{5,}'))), ',')} AS shared FROM pairs")
operator(
    "set_03_ordered_dedupe",
    lambda d: f"""WITH w AS ({d.explode('conversations', 'conv_id, turn', d.all('lower(text)', '[a-zß-öø-ÿ]+'), 'i', 'word')}), f AS (SELECT conv_id, turn, word, min(i) AS i FROM w GROUP BY conv_id, turn, word)
    SELECT conv_id, turn, {d.join(d.collect('word', 'i'), ' ')} AS words FROM f GROUP BY conv_id, turn""",
)
# SET-04: an item moves up if it and the one before it both wait.
operator(
    "set_04_queue_move",
    lambda d: with_(items(d)) + """, q AS (SELECT job, k, state, lag(state) OVER w AS before, lead(state) OVER w AS after, lag(k) OVER w AS kb, lead(k) OVER w AS ka FROM items WINDOW w AS (PARTITION BY job ORDER BY k))
    SELECT job, k, CASE WHEN k % 2 = 1 AND state = 'waiting' AND before = 'waiting' THEN kb WHEN k % 2 = 0 AND state = 'waiting' AND after = 'waiting' THEN ka ELSE k END AS place FROM q""",
)
