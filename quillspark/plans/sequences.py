"""Order-dependent structure as windows (BLK), and state machines as expressions over items (ST)."""

from quillspark.plans.dialect import blocks, draft, items, lines, operator, oracle, pairs, with_
from quillspark.plans.relations import MARK_CASE
from quillspark.plans.scalars import refusal

PAGE_NUMBER = "(?i)^[^0-9A-Za-z]*([0-9]{1,4}|[ivxlcdm]{1,7})[^0-9A-Za-z]*$"
END = '[.!?:;…"”»)]\\s*$'

operator("blk_02_page_furniture", lambda d: with_(lines(d)) + f"SELECT doc_id, ord, line FROM lines WHERE trim(line) <> '' AND NOT {d.has('trim(line)', PAGE_NUMBER)}")
# BLK-03: paragraphs as islands: blank lines end them, list markers open them.
operator(
    "blk_03_paragraphs",
    lambda d: with_(lines(d)) + f""", s AS (SELECT doc_id, ord, line, CASE WHEN {d.has('trim(line)', '^([0-9]{1,3}[.)]|[a-z][)]|[IVXLC]{1,6}[.]) +[^ ]')} OR coalesce(lag(trim(line)) OVER w, '') = '' THEN 1 ELSE 0 END AS opens FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    i AS (SELECT doc_id, ord, line, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS paragraph FROM s WHERE trim(line) <> '')
    SELECT doc_id, paragraph, {d.join(d.collect('trim(line)', 'ord'), ' ')} AS text FROM i GROUP BY doc_id, paragraph""",
)
# BLK-04: what looks like a title.
operator(
    "blk_04_titles",
    lambda d: with_(lines(d)) + f"""SELECT doc_id, ord, CASE WHEN length(t) > 90 OR length(t) < 3 OR {d.has('t', '[,;]$')} OR ({d.has('t', '[.] *$')} AND NOT {d.has('t', '^[IVXLC]+[.]')}) THEN false WHEN NOT {d.has('t', '[A-Za-zÀ-ÿ]')} THEN false
      WHEN length(t) < 60 AND NOT {d.has('t', '[.!?:;,] *$')} AND {d.has('t', '^[A-ZÀ-ÖØ-Þ]')} AND NOT {d.has('t', '^([0-9]{1,3}[.)]|[a-z][)])')} THEN true
      ELSE CAST({d.n('t', '[A-ZÀ-ÖØ-Þ]')} AS DOUBLE) / {d.n('t', '[A-Za-zÀ-ÖØ-öø-ÿ]')} > 0.75 OR {d.has('t', '(?i)^(cap[ií]tulo|chapter|kapitel|parte|part|teil|livro|book|introduction)([^A-Za-z]|$)')} END AS title
    FROM (SELECT doc_id, ord, trim(line) AS t FROM lines) q""",
)
# BLK-06: a title glued to the end of a line becomes a row of its own. Every fourth line ends in one here.
operator(
    "blk_06_glued_title",
    lambda d: with_(lines(d)) + f""", g AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 1 THEN concat(line, 'THE NEXT PART') ELSE line END AS line FROM lines),
    t AS (SELECT doc_id, ord, {d.first('line', '[a-zà-ÿ][.!?]([A-ZÀ-Ý][A-ZÀ-Ý ]{3,40})$', 1)} AS title, {d.rx('line', '([a-zà-ÿ][.!?])[A-ZÀ-Ý][A-ZÀ-Ý ]{3,40}$', '$1')} AS rest FROM g)
    SELECT doc_id, ord, CAST(0 AS BIGINT) AS part, 'line' AS kind, rest AS text FROM t UNION ALL SELECT doc_id, ord, CAST(1 AS BIGINT), 'heading', title FROM t WHERE title <> ''""",
)
# BLK-07: continuation: only the tail of what was merged counts, so the line before decides; islands by a running sum.
operator(
    "blk_07_continuation",
    lambda d: with_(blocks(d)) + f""", c AS (SELECT doc_id, ord, text, page, CASE WHEN kind = 'paragraph' AND lag(kind) OVER w = 'paragraph' AND NOT {d.has('lag(text) OVER w', END.replace('\\s', '[ ]'))} AND (page = lag(page) OVER w + 1 OR (page = lag(page) OVER w AND {d.has('text', '^[a-zß-öø-ÿ]')})) THEN 0 ELSE 1 END AS opens FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    i AS (SELECT doc_id, ord, text, page, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM c)
    SELECT doc_id, block, min(page) AS first_page, max(page) AS last_page, {d.join(d.collect('text', 'ord'), ' ')} AS text FROM i GROUP BY doc_id, block""",
)
# BLK-08: in a book few of whose pages have their text over an image (a fifth at most), only the image paragraphs of those pages stay.
# Images: every third block; pages over an image: every sixth, in books of odd number every second.
operator(
    "blk_08_image_pages",
    lambda d: with_(blocks(d)) + f""", b AS (SELECT doc_id, ord, page, page % (CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 6 END) = 0 AS over_image, CASE WHEN ord % 3 = 0 THEN concat('![](', id, '.png)') ELSE text END AS text FROM blocks),
    s AS (SELECT doc_id, count(DISTINCT page) AS pages, count(DISTINCT CASE WHEN over_image THEN page END) AS over_pages FROM b GROUP BY doc_id)
    SELECT b.doc_id, b.ord, CAST(b.page AS BIGINT) AS page, {d.has('b.text', '^!')} AS image FROM b JOIN s ON b.doc_id = s.doc_id WHERE NOT b.over_image OR s.over_pages > 0.2 * s.pages OR {d.has('b.text', '^!')}""",
)
operator(
    "blk_10_markdown_blocks",
    lambda d: with_(lines(d)) + f""", m AS (SELECT doc_id, ord, CASE WHEN ord % 9 = 0 THEN concat('## ', line) WHEN ord % 9 = 1 THEN concat('> ', line) WHEN ord % 9 = 2 THEN concat('- ', line) ELSE line END AS t FROM lines WHERE trim(line) <> '')
    SELECT doc_id, ord, CASE WHEN {d.has('t', '^#{1,6} ')} THEN 'heading' WHEN {d.has('t', '^!')} THEN 'image' ELSE 'paragraph' END AS kind, CASE WHEN {d.has('t', '^> ')} THEN '> ' ELSE {d.first('t', '^([-*+] |[0-9]+[.] )', 1)} END AS prefix, {d.rx('t', '^(#{1,6} |> |[-*+] |[0-9]+[.] )')} AS text,
      CAST(sum(CASE WHEN {d.has('t', '^#{1,6} ')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS section FROM m""",
)
operator("blk_11_dense_levels", lambda d: "SELECT l_orderkey AS book, CAST(l_linenumber AS BIGINT) AS level, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS dense FROM lineitem")
operator(
    "blk_12_numbering",
    lambda d: with_(lines(d)) + f""", n AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN concat(CAST(ord + 1 AS STRING), '. ', line) ELSE line END AS text FROM lines WHERE trim(line) <> '')
    SELECT doc_id, ord, concat('b', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS STRING), 5, '0')) AS id, {d.first('text', '^([0-9]{1,4})[.] ', 1)} AS number FROM n""",
)
# BLK-13: section path: the last first-level title is carried down, second-level ones within it.
operator(
    "blk_13_section_path",
    lambda d: with_(blocks(d)) + """, h AS (SELECT doc_id, ord, CASE WHEN ord % 8 = 0 THEN 1 WHEN ord % 4 = 0 THEN 2 END AS level FROM blocks),
    a AS (SELECT doc_id, ord, level, max(CASE WHEN level = 1 THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h1 FROM h),
    b AS (SELECT doc_id, ord, level, h1, max(CASE WHEN level = 2 THEN ord END) OVER (PARTITION BY doc_id, h1 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h2 FROM a)
    SELECT doc_id, ord, concat_ws(' › ', CAST(h1 AS STRING), CAST(h2 AS STRING), concat('paragraph ', CAST(ord AS STRING))) AS label FROM b WHERE level IS NULL""",
)
operator("blk_15_page_markers", lambda d: with_(blocks(d)) + "SELECT doc_id, ord, page, CASE WHEN doc_id % 10 >= 8 THEN 'ok' ELSE 'check' END AS confidence FROM (SELECT doc_id, ord, page, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS was FROM blocks) q WHERE was IS NULL OR was <> page")
operator(
    "blk_16_line_rendering",
    lambda d: with_(draft(d)) + f", t AS (SELECT doc_id, kind, trim({d.rx('''coalesce(nullif(edited, ''), result, '')''', '[ \t\n]+', ' ')}) AS t FROM draft) SELECT doc_id, CASE WHEN kind = 'heading' THEN concat('# ', {d.rx('t', '^[# ]+')}) WHEN {d.has('t', '^[0-9]{1,4}[.] ')} THEN concat('[', {d.first('t', '^([0-9]{1,4})[.] ', 1)}, '.]{{.pnum}} ', {d.rx('t', '^[0-9]{1,4}[.] +')}) ELSE t END AS line FROM t",
)
operator(
    "blk_17_neighbours",
    lambda d: with_(blocks(d)) + ", p AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN ord * 10 END AS spot FROM blocks) SELECT doc_id, ord, max(spot) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(spot) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM p",
)
operator("blk_18_gaps", lambda d: "WITH p AS (SELECT user_id, event_id, " + d.epoch("ts") + " AS moment FROM events) SELECT user_id, event_id, moment - before AS gap FROM (SELECT user_id, event_id, moment, lag(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS before FROM p) q WHERE moment - before > 40")
operator("blk_19_page_neighbours", lambda d: with_(blocks(d)) + ", p AS (SELECT DISTINCT doc_id, page FROM blocks) SELECT doc_id, page, lag(page) OVER w AS previous, lead(page) OVER w AS following, CAST(row_number() OVER w AS BIGINT) AS k, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)")
operator(
    "blk_20_sync_edits",
    lambda d: with_(lines(d)) + """, g AS (SELECT doc_id, ord, line FROM lines), c AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 1 THEN concat(line, '!') ELSE line END AS line FROM lines WHERE NOT (doc_id % 6 = 0 AND ord = 1)),
    j AS (SELECT coalesce(g.doc_id, c.doc_id) AS doc_id, coalesce(g.ord, c.ord) AS ord, g.line AS a, c.line AS b FROM g FULL OUTER JOIN c ON g.doc_id = c.doc_id AND g.ord = c.ord)
    SELECT doc_id, max(CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 0 END) = 1 AS rejected, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS edited FROM j GROUP BY doc_id""",
)
operator(
    "aln_03_strip_markdown",
    lambda d: with_(lines(d)) + f"SELECT doc_id, ord, {d.rx(d.rx(d.rx('line', '<[^>]+>', ' '), r'!?\[([^\]]*)\]\([^() ]+\)', '$1'), '[*_#>]', ' ')} AS plain FROM lines",
)
# ALN-08: a paragraph's letters must be in its book's letters; in a paged output, all but two of their chunks of 30. Paragraphs of three letters
# or fewer don't count. Output: every seventh line cut, every fifth with a page number and a note in its middle, every ninth with another word at its end.
oracle(
    "aln_08_completeness",
    lambda d: with_(lines(d)) + f""", p AS (SELECT doc_id, ord, {d.rx('lower(line)', '[^a-zà-ÿ]+')} AS letters FROM lines),
    o AS (SELECT doc_id, ord, CASE WHEN ord % 7 = 3 THEN '' WHEN ord % 5 = 1 THEN concat(substring(line, 1, CAST(length(line) / 2 AS INT)), ' 12 a note below ', substring(line, CAST(length(line) / 2 AS INT) + 1, CAST(length(line) AS INT))) WHEN ord % 9 = 5 THEN concat(line, 'x') ELSE line END AS line FROM lines),
    b AS (SELECT doc_id, {d.rx(d.join(d.collect('lower(line)', 'ord'), ''), '[^a-zà-ÿ]+')} AS book FROM o GROUP BY doc_id),
    c AS (SELECT p.doc_id, p.ord, p.letters, b.book, {d.map(d.range('0', 'greatest(1, floor(length(p.letters) / 30))'), 'k', "substring(p.letters, CAST(k * 30 + 1 AS INT), CASE WHEN length(p.letters) < 30 THEN CAST(length(p.letters) AS INT) ELSE 30 END)")} AS chunks FROM p JOIN b ON p.doc_id = b.doc_id WHERE length(p.letters) > 3)
    SELECT doc_id, ord, {d.contains('book', 'letters')} AS whole, {d.size(d.keep('chunks', 'x', f"NOT {d.contains('book', 'x')}"))} <= 2 AS in_pages FROM c""",
)
operator("aln_09_accepted_contained", lambda d: with_(draft(d)) + f"SELECT r.doc_id, {d.contains(d.rx('d.text', '[ \t\n]+', ' '), d.rx('coalesce(r.edited, r.result)', '[ \t\n]+', ' '))} AS contained FROM draft r JOIN documents d ON d.doc_id = r.doc_id WHERE r.accepted")
operator(
    "aln_11_quick_ratio",
    lambda d: with_(pairs(d)) + f""", a AS (SELECT conv_id, turn, w, count(*) AS n FROM ({d.explode('pairs', 'conv_id, turn', d.all('lower(src)', '[a-zß-öø-ÿ]+'), 'i', 'w')}) GROUP BY conv_id, turn, w), b AS (SELECT conv_id, turn, w, count(*) AS n FROM ({d.explode('pairs', 'conv_id, turn', d.all('lower(out)', '[a-zß-öø-ÿ]+'), 'i', 'w')}) GROUP BY conv_id, turn, w),
    j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS m, coalesce(a.n, 0) + coalesce(b.n, 0) AS t FROM a FULL OUTER JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.w = b.w)
    SELECT conv_id, turn, round(CAST(2 * sum(m) AS DOUBLE) / sum(t), 6) AS quick_ratio FROM j GROUP BY conv_id, turn""",
)

# --- state machines ---
operator("st_01_phase", lambda d: with_(items(d)) + "SELECT job, k, CASE WHEN proposal IS NULL THEN 'propose' WHEN audit_ok IS NULL THEN 'audit' WHEN (audit_ok = 0 OR coalesce(checks, '[]') <> '[]') AND revised IS NULL THEN 'revise' WHEN revised IS NOT NULL AND audit2_ok IS NULL THEN 'reaudit' WHEN audit2_ok = 0 AND verdict IS NULL THEN 'judge' ELSE 'end' END AS phase FROM items")
operator("st_02_correction_gate", lambda d: with_(items(d)) + "SELECT job, k, CASE WHEN revised IS NULL OR length(revised) < 0.5 * length(proposal) OR revised LIKE '%translated as%' THEN proposal ELSE revised END AS kept FROM items WHERE proposal IS NOT NULL")
operator("st_05_block_mark", lambda d: with_(items(d)) + f"SELECT job, k, {MARK_CASE} AS mark FROM items")
operator("st_06_draft_status", lambda d: with_(draft(d)) + "SELECT doc_id, CASE WHEN status = 'running' THEN 'running' WHEN kind = 'heading' AND status <> 'judge' THEN 'review' WHEN doc_id % 17 = 0 THEN 'review' ELSE status END AS status FROM draft")
operator(
    "st_09_snapshot_events",
    lambda d: with_(items(d)) + """, s AS (SELECT job, k, CAST(count(proposal) OVER w AS BIGINT) AS p, CAST(count(audit_ok) OVER w AS BIGINT) AS a FROM items WINDOW w AS (PARTITION BY job ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    l AS (SELECT job, k, p - lag(p, 1, 0) OVER w AS dp, a - lag(a, 1, 0) OVER w AS da FROM s WINDOW w AS (PARTITION BY job ORDER BY k))
    SELECT job, k, CASE WHEN dp = 1 AND da = 0 THEN 'proposed' WHEN dp = 0 AND da = 1 THEN 'audited' ELSE 'none' END AS event FROM l""".replace("lag(p, 1, 0)", "coalesce(lag(p) OVER w, 0)").replace("lag(a, 1, 0)", "coalesce(lag(a) OVER w, 0)").replace(" OVER w, 0) OVER w", " OVER w, 0)"),
)
operator("st_11_crash_reset", lambda d: with_(items(d)) + "SELECT job, k, CASE WHEN state = 'waiting' AND proposal IS NOT NULL THEN 'queued' ELSE state END AS state FROM items")
operator("st_12_log_tail", lambda d: "SELECT user_id, event_id, n, total FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM events) q WHERE n > 10")
operator(
    "st_15_proof_verify",
    lambda d: with_(draft(d)) + f""", was AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'changed' ELSE {d.sha('''coalesce(text, '')''')} END AS sha FROM documents WHERE doc_id % 23 <> 0), now AS (SELECT doc_id, {d.sha('''coalesce(result, '')''')} AS sha FROM draft WHERE doc_id % 29 <> 0)
    SELECT coalesce(w.doc_id, n.doc_id) AS doc_id, CASE WHEN w.doc_id IS NULL THEN 'not recorded' WHEN n.doc_id IS NULL THEN 'gone' ELSE 'text differs' END AS message FROM was w FULL OUTER JOIN now n ON w.doc_id = n.doc_id WHERE w.sha IS NULL OR n.sha IS NULL OR w.sha <> n.sha""",
)
