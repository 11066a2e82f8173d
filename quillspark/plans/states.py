"""State changes of review as relations: verdicts, accepts and redoing (ST-03, ST-07, ST-10)."""

from quillspark.plans.dialect import draft, items, operator, pairs, with_
from quillspark.plans.search import MARK

#: Problems that not even the judge may release.
LOCKED = "number of the source|fewer sentences|refusal|invented|empty|glossary:"
#: Kinds of problems are told apart by so many letters.
KIND = 14
#: Least certainty of a vote that releases an objection.
CERTAIN = 0.3


def _problems(d, text: str) -> str:
    """The kinds of problems that ``text`` has against ``src``, as an array."""
    found = {
        "number of the source missing": f"{d.size(d.without(d.distinct(d.all('src', '[0-9]+')), d.distinct(d.all(text, '[0-9]+'))))} > 0",
        "fewer sentences than the source": f"{d.n(text, '[.!?…]')} < {d.n('src', '[.!?…]')}",
        "emphasis differs from the source": f"{d.n('src', '[*]')} <> {d.n(text, '[*]')}",
        "empty result": f"trim({text}) = ''",
    }
    named = d.array(*(f"CASE WHEN {test} THEN {d.lit(name)} ELSE '' END" for name, test in found.items()))
    return d.keep(named, "p", "p <> ''")


# ST-03: the judge's verdict on an item. Objections stand that are upheld or locked. If none stands, the version stays: the translator won, or the
# user decides where a vote was not certain. Else the correction is taken, if it brings no problem of a kind that the version did not have (released kinds
# may come, locked ones not), keeps question and exclamation marks, and brings back no word of the source. Votes and corrections go by number here.
operator(
    "st_03_verdict",
    lambda d: with_(pairs(d)) + f""", base AS (SELECT conv_id, turn, concat(src, ' 7 *x*') AS src, concat(out, CASE WHEN conv_id % 4 = 1 THEN ' *x*' ELSE ' 7 *x*' END) AS version FROM pairs),
    v AS (SELECT conv_id, turn, src, version, CASE (conv_id + turn) % 6 WHEN 0 THEN concat(version, ' 7') WHEN 1 THEN concat(version, ' ok?') WHEN 2 THEN concat(version, ' ', {d.first('src', '[a-zà-ÿ]{5,}')}) WHEN 3 THEN replace(version, '*', '') WHEN 4 THEN replace(version, '.', '') ELSE concat(version, ' 7.') END AS fixed FROM base),
    o AS (SELECT v.conv_id, v.turn, q.i, q.problem, (v.conv_id + v.turn + q.i) % 3 = 0 AS upheld, CAST((v.conv_id * 7 + q.i * 31) % 100 AS DOUBLE) / 100 AS certainty FROM v CROSS JOIN (VALUES (1, 'number of the source missing: 7'), (2, 'emphasis differs from the source'), (3, 'style: stiff')) AS q(i, problem) WHERE q.i > 1 OR v.conv_id % 4 = 1),
    j AS (SELECT *, upheld OR {d.has('problem', LOCKED)} AS stands, NOT upheld AND NOT {d.has('problem', LOCKED)} AND certainty < {CERTAIN} AS doubtful FROM o),
    s AS (SELECT conv_id, turn, sum(CASE WHEN stands THEN 1 ELSE 0 END) AS standing, sum(CASE WHEN doubtful THEN 1 ELSE 0 END) AS doubts, {d.collect(f"CASE WHEN upheld THEN '' ELSE substring(problem, 1, {KIND}) END", 'i')} AS released FROM j GROUP BY conv_id, turn),
    c AS (SELECT v.*, s.standing, s.doubts, s.released, {d.map(_problems(d, 'version'), 'p', f'substring(p, 1, {KIND})')} AS had, {_problems(d, 'fixed')} AS has FROM v JOIN s ON s.conv_id = v.conv_id AND s.turn = v.turn),
    n AS (SELECT *, {d.size(d.keep('has', 'p', f"NOT {d.within('had', f'substring(p, 1, {KIND})')} AND ({d.has('p', LOCKED)} OR NOT {d.within('released', f'substring(p, 1, {KIND})')})"))} AS fresh,
      {d.n('fixed', '[?]')} <> {d.n('version', '[?]')} OR {d.n('fixed', '!')} <> {d.n('version', '!')} AS marks,
      {d.size(d.both(d.without(d.distinct(d.all('fixed', '[a-zà-ÿ]{5,}')), d.distinct(d.all('version', '[a-zà-ÿ]{5,}'))), d.distinct(d.all('src', '[a-zà-ÿ]{5,}'))))} AS back FROM c)
    SELECT conv_id, turn, CAST(standing AS BIGINT) AS standing, CAST(doubts AS BIGINT) AS doubts, fresh, marks, back,
      CASE WHEN standing = 0 AND doubts > 0 THEN 'user' WHEN standing = 0 THEN 'translator' WHEN fresh = 0 AND NOT marks AND back = 0 THEN 'auditor' ELSE 'user' END AS winner,
      CASE WHEN standing > 0 AND fresh = 0 AND NOT marks AND back = 0 THEN fixed ELSE version END AS text FROM n""",
)

# ST-07: requests on draft blocks, one for each block here: accept, accept with a new text, undo, set the level, accept all approved, accept at the end.
# 404: no such block; 400: a new text for several blocks, a level that is none, a broken mark in the text, nothing to change; 409: the block is still worked on. Requests
# for all leave out blocks with broken marks and those in work instead.
operator(
    "st_07_accept_log",
    lambda d: with_(draft(d)) + f""", k AS (SELECT q.doc_id, b.book, b.status, b.accepted, b.kind, b.edited, b.result FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 5 THEN doc_id + 1000000000 ELSE doc_id END AS target FROM documents) q LEFT JOIN draft b ON b.doc_id = q.target),
    r AS (SELECT doc_id, book, status AS was, accepted, kind, coalesce(nullif(edited, ''), result, '') AS body, CASE doc_id % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'text' WHEN 2 THEN 'undo' WHEN 3 THEN 'level' WHEN 4 THEN 'approved' ELSE 'end' END AS action,
      CASE WHEN doc_id % 6 = 1 THEN 1 + CAST(doc_id % 5 = 2 AS INT) ELSE 1 END AS ids, doc_id % 9 - 1 AS level FROM k),
    t AS (SELECT *, CASE WHEN action = 'text' THEN concat(body, ' corrected', CASE WHEN doc_id % 4 = 1 THEN ' <a1>' ELSE '' END) WHEN doc_id % 8 = 4 THEN concat(body, ' <n2/>') ELSE body END AS text FROM r),
    m AS (SELECT *, {d.has("replace(text, '<br>', '')", MARK)} AS broken, action IN ('approved', 'end') AS bulk FROM t),
    s AS (SELECT *, CASE WHEN was IS NULL THEN 404 WHEN action = 'text' AND ids <> 1 THEN 400 WHEN NOT bulk AND action <> 'undo' AND was = 'running' THEN 409 WHEN action = 'level' AND (kind = 'image' OR level NOT BETWEEN 0 AND 6) THEN 400 WHEN action IN ('accept', 'text') AND broken THEN 400
      WHEN action = 'approved' AND (was <> 'approved' OR accepted OR broken) THEN 204 WHEN action = 'end' AND (was = 'running' OR accepted OR broken) THEN 204 ELSE 200 END AS code FROM m)
    SELECT doc_id, action, CAST(code AS BIGINT) AS code, CASE WHEN code <> 200 OR action = 'level' THEN accepted ELSE action <> 'undo' END AS accepted, code = 200 AND action = 'end' AS automatic,
      CASE WHEN code = 200 AND action = 'level' THEN CASE WHEN level > 0 THEN 'heading' ELSE 'paragraph' END ELSE kind END AS kind, CASE WHEN code = 200 AND action = 'text' THEN trim(text) ELSE body END AS text FROM s""",
)

# ST-10: redoing a job: all of it, the audit only, given blocks (every fourth), the judge only, or the checks only. Accepted blocks stay where the judge or
# the checks are redone; checks that come out as before leave their item alone. The new checks: whether the text has an even length.
CHECKED = "CASE WHEN length({x}) % 2 = 0 THEN '[\"mark\"]' ELSE '[]' END"


def _redo(d) -> str:
    asked = "mode = 'all' OR (mode = 'blocks' AND k % 4 = 1)"
    audit = "mode = 'audit' AND proposal IS NOT NULL"
    own = "mode = 'checks' AND verdict IS NULL AND NOT accepted AND proposal IS NOT NULL"
    gone = f"({asked}) OR ({audit})"
    new1, new2 = CHECKED.format(x="proposal"), CHECKED.format(x="revised")
    changed1, changed2 = f"({own}) AND revised IS NULL AND {new1} <> coalesce(checks, '[]')", f"({own}) AND revised IS NOT NULL AND {new2} <> coalesce(checks2, '[]')"
    return f"""SELECT job, k, mode, CASE WHEN {asked} THEN NULL ELSE proposal END AS proposal,
      CASE WHEN {asked} THEN NULL WHEN ({audit}) OR ({changed1}) THEN {new1} ELSE checks END AS checks, CASE WHEN {gone} THEN NULL ELSE audit_ok END AS audit_ok,
      CASE WHEN {gone} THEN NULL ELSE revised END AS revised, CASE WHEN {gone} THEN NULL WHEN {changed2} THEN {new2} ELSE checks2 END AS checks2, CASE WHEN {gone} THEN NULL ELSE audit2_ok END AS audit2_ok,
      CASE WHEN mode IN ('all', 'judge') THEN NULL ELSE judged END AS judged, CASE WHEN mode IN ('all', 'judge') THEN NULL ELSE verdict END AS verdict,
      CASE WHEN {gone} OR (mode = 'judge' AND NOT accepted) OR ({changed1}) OR ({changed2}) THEN 'queued' ELSE state END AS state FROM m"""


operator(
    "st_10_redo_modes",
    lambda d: with_(items(d)) + ", m AS (SELECT *, (job + k) % 5 = 0 AS accepted, CASE job % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'audit' WHEN 2 THEN 'blocks' WHEN 3 THEN 'judge' ELSE 'checks' END AS mode FROM items) " + _redo(d),
)
