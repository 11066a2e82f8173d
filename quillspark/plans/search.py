"""Scans, projections, filters and search (SRC, FLT)."""

from quillspark.plans.dialect import blocks, draft, lines, operator, oracle, page_lines, with_

WORDS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"

# FLT-01: all terms, accents and case folded; a snippet around the first; 60 hits at most, by book and place.
operator(
    "flt_01_search",
    lambda d: with_(lines(d)) + f""", hits AS (SELECT doc_id, source, ord, line, {d.fold('line')} AS f FROM lines)
    SELECT source AS book, doc_id, ord, substring(line, CAST(greatest(1, strpos(f, 'est') - 90) AS INT), 260) AS snippet FROM hits
    WHERE {d.contains('f', "'est'")} AND {d.contains('f', "'tion'")} ORDER BY source, doc_id, ord LIMIT 60""".replace("strpos(f, 'est')", "instr(f, 'est')"),
)
# FLT-02: regular expression over folded text: the count of its matches, and the first with its context, as the line has it; partial book name.
FOUND = "an[a-z]+ti"
AROUND = 40


def context(d, line: str, at: str, found: str) -> str:
    """``found`` (its place and text in ``line``) between quotes, with AROUND letters on either side and dots where more is left out."""
    before = f"concat(CASE WHEN {at} > {AROUND + 1} THEN '…' ELSE '' END, substring({line}, CAST(greatest(1, {at} - {AROUND}) AS INT), CAST(least({at} - 1, {AROUND}) AS INT)))"
    end = f"({at} + length({found}))"
    after = f"concat(substring({line}, CAST({end} AS INT), {AROUND}), CASE WHEN length({line}) >= {end} + {AROUND} THEN '…' ELSE '' END)"
    return f"concat({before}, '«', substring({line}, CAST({at} AS INT), CAST(length({found}) AS INT)), '»', {after})"


operator(
    "flt_02_regex_search",
    lambda d: with_(lines(d)) + f""", f AS (SELECT doc_id, ord, line, {d.fold('line')} AS folded FROM lines WHERE {d.contains('source', repr('src1'))}),
    m AS (SELECT doc_id, ord, line, {d.n('folded', FOUND)} AS hits, {d.first('folded', FOUND)} AS found, instr(folded, {d.first('folded', FOUND)}) AS spot FROM f WHERE {d.has('folded', FOUND)})
    SELECT doc_id, ord, hits, {context(d, 'line', 'spot', 'found')} AS context FROM m""",
)
operator("flt_04_title_author", lambda d: f"SELECT c_custkey, c_name FROM customer WHERE {d.contains(d.fold('''concat(c_name, ' ', c_mktsegment)'''), repr('9 build'))}")
operator(
    "flt_05_page_class",
    lambda d: f"SELECT doc_id, CAST(length({d.rx(d.rx('''coalesce(text, '')''', '^[ \t\n\r]+'), '[ \t\n\r]+$')}) AS BIGINT) AS chars, CASE WHEN length(trim(coalesce(text, ''))) > 200 THEN 'digital' WHEN length(trim(coalesce(text, ''))) < 20 THEN 'empty or image' ELSE 'little text' END AS class FROM documents",
)
MARK = "</?[aib][0-9]+>|<n[0-9]+/>|<br>"
operator("flt_06_has_letters", lambda d: with_(lines(d)) + f"SELECT doc_id, ord, {d.has(d.rx('line', MARK), '[A-Za-zÀ-ÿ]')} AS letters FROM lines")
# FLT-07: review tabs with counts, and the first tab that has rows.
operator(
    "flt_07_review_tabs",
    lambda d: with_(draft(d)) + """, t AS (SELECT book,
      CAST(sum(CASE WHEN status = 'review' AND NOT accepted THEN 1 ELSE 0 END) AS BIGINT) AS review, CAST(sum(CASE WHEN status = 'judge' AND NOT accepted THEN 1 ELSE 0 END) AS BIGINT) AS judge,
      CAST(sum(CASE WHEN status = 'approved' AND NOT accepted THEN 1 ELSE 0 END) AS BIGINT) AS approved, CAST(sum(CASE WHEN status = 'running' AND NOT accepted THEN 1 ELSE 0 END) AS BIGINT) AS running,
      CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(count(*) AS BIGINT) AS everything FROM draft GROUP BY book)
    SELECT *, CASE WHEN review > 0 THEN 'review' WHEN judge > 0 THEN 'judge' WHEN approved > 0 THEN 'approved' WHEN running > 0 THEN 'running' ELSE 'everything' END AS opens FROM t""",
)
operator("flt_08_eligible_blocks", lambda d: with_(blocks(d)) + f"SELECT doc_id, id, kind FROM blocks WHERE kind IN ('paragraph', 'heading') AND {d.has(d.rx('text', MARK), '[A-Za-zÀ-ÿ]')}")
operator(
    "flt_09_uncertain_parts",
    lambda d: with_(draft(d)) + """SELECT book, doc_id, CAST(row_number() OVER (PARTITION BY book ORDER BY doc_id) AS BIGINT) AS number,
      concat(CASE WHEN status = 'judge' THEN 'corrected by the judge: ' ELSE '' END, concat_ws('; ', CASE WHEN edited IS NOT NULL THEN 'edited' END, CASE WHEN result IS NULL OR length(result) < 200 THEN 'short' END)) AS reason
    FROM draft WHERE NOT accepted AND status IN ('review', 'judge')""",
)
# FLT-10: books that must not be processed again: some text is accepted, or the source is handmade.
operator(
    "flt_10_guard",
    lambda d: with_(draft(d)) + "SELECT book, max(CASE WHEN accepted THEN 1 ELSE 0 END) = 1 OR min(CASE WHEN automatic THEN 1 ELSE 0 END) = 1 AS refused FROM draft GROUP BY book",
)
# FLT-11: editable lines with the page marker carried down; comments, fences, tables and images are skipped.
operator(
    "flt_11_editable_lines",
    lambda d: with_(lines(d)) + f""", m AS (SELECT doc_id, ord, line, CASE WHEN {d.has('line', '^[^ ]+[.]$')} THEN line END AS marker FROM lines),
    c AS (SELECT doc_id, ord, line, marker, max(CASE WHEN marker IS NOT NULL THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM m)
    SELECT doc_id, ord, carried AS marker_line, CASE WHEN {d.has('line', '^#')} THEN 'title' ELSE 'paragraph' END AS type FROM c WHERE marker IS NULL AND trim(line) <> '' AND NOT {d.has('line', '^(<!--|:::|[|]|!)')}""",
)
# FLT-12: anchors of notes: the first line of the book that starts with the anchor's folded text; anchors without a line are reported. Anchors here:
# the third line of every fifth document as a whole, and one that no line has.
oracle(
    "flt_12_anchor_resolve",
    lambda d: with_(lines(d)) + f""", f AS (SELECT doc_id, ord, {d.fold('line')} AS folded FROM lines),
    anchors AS (SELECT doc_id, CONCAT('line ', CAST(ord AS STRING)) AS name, folded AS start FROM f WHERE doc_id % 5 = 0 AND ord = 2 AND folded <> '' UNION ALL SELECT doc_id, 'absent', concat(folded, ' is nowhere') FROM f WHERE doc_id % 10 = 0 AND ord = 0),
    placed AS (SELECT a.doc_id, a.name, min(f.ord) AS ord FROM anchors a JOIN f ON f.doc_id = a.doc_id AND substring(f.folded, 1, CAST(length(a.start) AS INT)) = a.start GROUP BY a.doc_id, a.name)
    SELECT a.doc_id, a.name, p.ord, p.ord IS NULL AS missing FROM anchors a LEFT JOIN placed p ON a.doc_id = p.doc_id AND a.name = p.name""",
)
# FLT-13: page ranges such as 1-5,9 clipped to the total.
operator(
    "flt_13_page_range",
    lambda d: f"""WITH r AS (SELECT o_orderkey, concat(CAST(o_orderkey % 9 + 1 AS STRING), '-', CAST(o_orderkey % 9 + 4 AS STRING), ',', CAST(o_orderkey % 20 + 1 AS STRING)) AS spec, o_orderkey % 15 + 1 AS total FROM orders),
    p AS ({d.explode('r', 'o_orderkey, total', d.split('spec', ','), 'part', 'span')}),
    b AS (SELECT o_orderkey, total, {d.ints(d.at(d.split('span', '-'), '1'))} AS lo, {d.ints(f"coalesce({d.at(d.split('span', '-'), '2')}, span)")} AS hi FROM p),
    e AS ({d.explode('b', 'o_orderkey, total', d.range('lo', 'least(hi, total) + 1'), 'nth', 'page')})
    SELECT DISTINCT o_orderkey, CAST(page AS BIGINT) AS page FROM e WHERE page >= 1""",
)
# SRC-04 and AGG-06: text of a copy: short lines among the first or last two of a page go if their letters recur there on a fifth of the book's pages
# (two at least), or if they have none.
operator(
    "src_04_copy_text",
    lambda d: with_(page_lines(d)) + f""", s AS (SELECT doc_id, source, ord, line, (up <= 2 OR down <= 2) AND length(line) < 60 AS edge, {d.rx('lower(line)', '[^a-zß-öø-ÿ]+')} AS k FROM page_lines),
    e AS (SELECT DISTINCT source, doc_id, k FROM s WHERE edge),
    n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM s GROUP BY source),
    heads AS (SELECT e.source, e.k FROM e JOIN n ON e.source = n.source GROUP BY e.source, e.k, n.pages HAVING count(*) >= greatest(2, 0.2 * n.pages))
    SELECT s.doc_id, s.ord, s.line FROM s LEFT JOIN heads h ON s.source = h.source AND s.k = h.k WHERE NOT (s.edge AND (h.k IS NOT NULL OR s.k = ''))""",
)
# SRC-05: page to text; scripts and styles go with their content, links and spans leave no space, other tags do.
operator(
    "src_05_html_to_text",
    lambda d: f"""WITH a AS (SELECT page_id, {d.rx(d.rx('''coalesce(html, '')''', '(?is)<script[^>]*>.*?</script>', ' '), '(?is)<style[^>]*>.*?</style>', ' ')} AS h FROM pages),
    b AS (SELECT page_id, {d.rx(d.rx('h', '(?i)</?(a|span|font)([ ][^>]*)?>', ''), '<[^>]+>', ' ')} AS t FROM a)
    SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM b""",
)
operator("src_06_strip_tags", lambda d: f"SELECT page_id, trim({d.rx('''coalesce(html, '')''', '<[^>]+>', ' ')}) AS text FROM pages")
# SRC-14: semicolon tables: fields lose separators and line breaks, rows without the first two fields go.
operator(
    "src_14_semicolon_rows",
    lambda d: f"SELECT doc_id, concat_ws(';', replace({d.rx('text', '[\n]+', ' ')}, ';', ','), lang, source) AS row FROM documents WHERE coalesce(trim(text), '') <> '' OR coalesce(trim(lang), '') <> ''",
)
# SRC-15: annotations: a heading opens a note (here: lines without lower-case start), what follows is its body.
operator(
    "src_15_annotations",
    lambda d: with_(lines(d)) + f""", h AS (SELECT doc_id, ord, line, CAST(sum(CASE WHEN {d.has('line', '^[A-ZÀ-Þ][^ ]*[.]')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS note FROM lines)
    SELECT doc_id, note, min(ord) AS first_line, CAST(count(*) AS BIGINT) AS body_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM h WHERE note > 0 GROUP BY doc_id, note""",
)
# SRC-16: front matter fields of a text.
operator(
    "src_16_front_matter",
    lambda d: f"""WITH f AS (SELECT c_custkey, concat('---', chr(10), 'title: "', c_name, '"', chr(10), 'author: "', c_mktsegment, '"', chr(10), '---', chr(10), 'body ', CAST(c_custkey AS STRING)) AS md FROM customer)
    SELECT c_custkey, {d.first('md', '(?m)^title: "(.*)"', 1)} AS title, {d.first('md', '(?m)^author: "(.*)"', 1)} AS author, {d.rx('md', '(?s)^---.*---[\n]', '')} AS body FROM f""",
)
operator("src_18_commits", lambda d: f"SELECT user_id, {d.sha('CAST(event_id AS STRING)')} AS commit, {d.epoch('ts')} AS at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS nth FROM events WHERE event_type = 'click'")
operator("src_21_net_log_tail", lambda d: f"SELECT event_id, event_type, {d.json('props', 'k')} AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
# SNK-03: source and target side by side, in one row of markup.
operator(
    "snk_03_side_by_side",
    lambda d: with_(blocks(d)) + f", k AS (SELECT page, doc_id, id, concat('<tr><td>', replace(text, '<', '&lt;'), '</td><td>', lower(text), '</td></tr>') AS row FROM blocks) SELECT doc_id, page, CAST(count(*) AS BIGINT) AS rows, {d.sha(d.join(d.collect('row', 'id'), ''))} AS html_sha FROM k GROUP BY doc_id, page",
)
