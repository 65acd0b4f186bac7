"""DuckDB SQL that says the same as the native operators, written apart from them: signals, edges and issues of a trace view as common table expressions."""

from __future__ import annotations

from ..functions import lexicon as lx
from .views import duck

NEG = "|".join(x.replace("'", "''") for x in lx.NEGATIONS)
HEDGE, CONTRAST, VERBS = "|".join(lx.HEDGES), "|".join(lx.CONTRASTS), "|".join(lx.ACTIONS)
RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
NAME = "CASE {0} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'clean' END"


def normal(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '’–—', '''--'), '\\s+', ' ', 'g'))"


def asserted(term: str, rank: int, hedges: bool) -> str:
    before, after = f"regexp_extract(n, '^(.*?)\\b{term}\\b', 1)", f"regexp_extract(n, '^.*?\\b{term}\\b(.*)$', 1)"
    out = f"regexp_matches(n, '\\b{term}\\b') AND NOT regexp_matches(right({before}, 18), '\\b(?:not|no|never)\\s+(?:been\\s+)?$')"
    if hedges and rank >= 2:
        lead, tail = f"regexp_extract({before}, '([^.!?;]*)$', 1)", f"regexp_extract({after}, '^([^.!?;]*)', 1)"
        near = f"regexp_matches({lead}, '\\b(?:{HEDGE})\\b') AND NOT regexp_matches(regexp_extract({lead}, '^.*\\b(?:{HEDGE})\\b(.*)$', 1), '\\b(?:{CONTRAST})\\b')"
        far = f"regexp_matches({tail}, '\\b(?:{HEDGE})\\b') AND NOT regexp_matches(regexp_extract({tail}, '^(.*?)\\b(?:{HEDGE})\\b', 1), '\\b(?:{CONTRAST})\\b')"
        out += f" AND NOT (({near}) OR ({far}))"
    return f"({out})"


def highest(lexicon: dict, hedges: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {asserted(t, r, hedges)} THEN '{t}'" for r in sorted(lexicon, reverse=True) for t in lexicon[r]) + " END"


def rank(lexicon: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN {r}" for r in lexicon for t in lexicon[r]) + " END"


#: The composed notes hold these forms of numbers only.
NUMBERS = """list_distinct(list_transform(regexp_extract_all(text, '\\$?[0-9]+(?:k\\b| percent| days?| hours?| weeks?)?'), lambda x:
  CASE WHEN x LIKE '%k' THEN regexp_replace(x, 'k$', '000') WHEN x LIKE '% percent' THEN replace(x, ' percent', '%') ELSE regexp_replace(replace(x, ' ', ''), 's$', '') END))"""
WORDS = f"""list_filter(list_distinct(string_split_regex(regexp_replace({normal("coalesce(guardrail, '')")}, '[^a-zÀ-ɏ0-9\\s''-]', ' ', 'g'), '\\s+')), lambda w:
  length(w) > 2 AND NOT regexp_matches(w, '^[0-9]') AND NOT list_contains([{", ".join(f"'{w}'" for w in lx.STOP_WORDS)}], w))"""
RESTRICT = "|".join(x.replace("'", "''") for x in lx.RESTRICTIONS)


ENDS = """e0 AS (SELECT c.run_id, lk.edge_index, c.guardrail, c.id AS tid, c.label AS tl, c.text AS tt, c.n AS n, c.cert AS ct, c.sc AS st, c.negs AS ng, c.acts, c.nums AS nn,
  p.id AS fid, p.label AS fl, p.text AS ft, p.n AS pn, p.cert AS pc, p.sc AS ps, p.negs AS pg, p.nums AS pnums
  FROM lk JOIN sig c ON c.run_id = lk.run_id AND c.stage_index = lk.ti JOIN sig p ON p.run_id = lk.run_id AND p.stage_index = lk.fi),"""
NEXT = """e0 AS (SELECT run_id, CAST(stage_index - 1 AS INT) AS edge_index, guardrail, id AS tid, label AS tl, text AS tt, n AS n, cert AS ct, sc AS st, negs AS ng, acts, nums AS nn,
  lag(id) OVER w AS fid, lag(label) OVER w AS fl, lag(text) OVER w AS ft, lag(n) OVER w AS pn, lag(cert) OVER w AS pc, lag(sc) OVER w AS ps, lag(negs) OVER w AS pg, lag(nums) OVER w AS pnums
  FROM sig WINDOW w AS (PARTITION BY run_id ORDER BY stage_index)),"""


def base(view: str, numbers: bool = True, stages: str | None = None, edges: str | None = None) -> str:
    """WITH st (stages), sig (their signals), ed (edges), iss (run_id, edge_index, type, family, severity, title, ord, fl, tl).

    stages: SQL in place of a view. edges: SQL of lk (run_id, edge_index, fi, ti: stage indexes) in place of neighbours; every edge's breach then counts.
    """
    one = lambda kind, sev, title, order, where: f"SELECT run_id, edge_index, '{kind}' AS type, '{lx.FAMILY[kind]}' AS family, {sev} AS severity, '{title}' AS title, {order} AS ord, fl, tl FROM ed WHERE NOT gone AND {where}"
    share = lambda n: f"CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: regexp_matches({n}, concat('\\b', w, '\\b')))) / len(words) ELSE 1.0 END"
    return f"""
WITH st AS ({stages or duck(view)}),
n0 AS (SELECT run_id, stage_index, id, label, trim(coalesce(text, '')) AS text, guardrail FROM st),
n1 AS (SELECT *, {normal("text")} AS n FROM n0),
sig AS (SELECT *, {highest(lx.CERTAINTY, True)} AS cert, {highest(lx.SCOPE)} AS sc, list_distinct(regexp_extract_all(n, '\\b(?:{NEG})\\b')) AS negs,
  regexp_extract_all(regexp_replace(n, '\\b(?:{NEG})\\b ?(?:[^ .!?;,:]+ ?){{0,3}}\\b(?:{VERBS})\\b', ' ', 'g'), '\\b(?:{VERBS})\\b') AS acts, {NUMBERS if numbers else "CAST([] AS VARCHAR[])"} AS nums FROM n1),
{f"lk AS ({edges})," + ENDS if edges else NEXT}
e1 AS (SELECT *, (ft = '' OR tt = '') AS gone, {rank(lx.CERTAINTY, "ct")} AS cr, {rank(lx.CERTAINTY, "pc")} AS pcr, {rank(lx.SCOPE, "st")} AS sr, {rank(lx.SCOPE, "ps")} AS psr, {WORDS} AS words FROM e0 WHERE edge_index >= 0),
ed AS (SELECT *, CASE WHEN {normal("coalesce(guardrail, '')")} = '' THEN NULL WHEN regexp_matches({normal("coalesce(guardrail, '')")}, '\\b(?:{RESTRICT})\\b') AND len(acts) > 0 THEN 'action'
  WHEN len(words) >= 2 AND {share("pn")} >= 0.3 AND {share("n")} < 0.3 THEN 'dropped' END AS breach FROM e1),
hit AS (SELECT run_id, {'' if edges else 'min'}(edge_index) AS edge_index FROM ed WHERE breach IS NOT NULL GROUP BY run_id{', edge_index' if edges else ''}),
iss AS ({one("number", "'high'", "Numeric claim changed", 0, "list_sort(nn) <> list_sort(pnums)")}
  UNION ALL {one("certainty", "CASE WHEN cr = 3 THEN 'high' ELSE 'medium' END", "Confidence was inflated", 1, "(cr > pcr OR (pcr IS NULL AND cr >= 2))")}
  UNION ALL {one("quantifier", "CASE WHEN sr = 4 THEN 'high' ELSE 'medium' END", "Scope became broader", 2, "(sr > psr OR (psr IS NULL AND sr >= 3))")}
  UNION ALL {one("negation", "'high'", "A negative condition disappeared", 3, "len(pg) > 0 AND len(ng) = 0")}
  UNION ALL SELECT run_id, edge_index, 'coverage', 'meaning', 'high', 'Stage content is missing', 0, fl, tl FROM ed WHERE gone
  UNION ALL SELECT run_id, edge_index, 'guardrail', 'authority', CASE breach WHEN 'action' THEN 'high' ELSE 'medium' END, CASE breach WHEN 'action' THEN 'Protected action appears completed' ELSE 'Guardrail was not carried forward' END, 1000, fl, tl
    FROM ed SEMI JOIN hit USING (run_id, edge_index)),
runs AS (SELECT run_id, count(*) AS n_stages FROM st GROUP BY run_id),
summ AS (SELECT runs.run_id, n_stages, count(i.type) AS n_issues, coalesce(max({RANK.replace("severity", "i.severity")}) FILTER (WHERE i.type IS NOT NULL), 0) AS r, min(i.edge_index) AS first_break FROM runs LEFT JOIN iss i ON i.run_id = runs.run_id GROUP BY runs.run_id, n_stages)
"""
