"""SQL of generated records, their predictions and rewards: what the operators must give, worked out by another engine.

The generator's choices are SHA-256 of (seed, index, what), so SQL can make the same records from nothing but their number.
``GENERATED`` is a chain of common table expressions that ends in ``rec``: one row per record.
"""

from __future__ import annotations

from labelframe.operators import programs as P
from labelframe.operators.rewards import ALL_TYPES, WEIGHTS
from labelframe.schema import FAMILY

SEED, TABLE = 20, "customer"


def choose(key: str, what: str, n: int | str, seed: int = SEED) -> str:
    return f"(('0x' || substr(sha256('{seed}|' || {key} || '|{what}'), 1, 15))::BIGINT % {n})"


def one_of(values, at: str) -> str:
    return f"([{', '.join(map(repr, values))}])[{at} + 1]"


_NONZERO = [v for v in range(-9, 10) if v]
_pick = lambda what, n: choose("idx", what, n)
_paren = lambda v: f"CASE WHEN {v} < 0 THEN concat('(', {v}, ')') ELSE concat('', {v}) END"


def _ratio(num: str, den: str) -> str:
    g = f"greatest(1, gcd({num}, {den}))"
    top, under = f"sign({den})::BIGINT * ({num}) // {g}", f"abs({den}) // {g}"
    return f"CASE WHEN {under} = 1 THEN concat('', {top}) ELSE concat({top}, '/', {under}) END"


def _texts(op: str) -> str:
    """Four step texts and the answer (num, den) of x, y, z under the mutation columns, or of the gold program for ``op`` NULL."""
    minus = f"((y > 0) <> ({op} IS NOT DISTINCT FROM 'op-transpose-sign'))"
    told, is_ = f"({op} IS NOT DISTINCT FROM 'op-llm-transpose-misconception')", lambda o: f"({op} IS NOT DISTINCT FROM '{o}')"
    at = lambda o, site: f"({op} IS NOT DISTINCT FROM '{o}' AND site = '{site}')"
    d = f"(CASE WHEN {told} THEN said_value WHEN {minus} THEN z - abs(y) ELSE z + abs(y) END + CASE WHEN {at('op-arith-slip', 's3')} THEN delta ELSE 0 END)"
    num = f"CASE WHEN {is_('op-divide-error')} AND kind = 'mul' THEN {d} * x WHEN {is_('op-divide-error')} THEN {d} + delta * x ELSE {d} END"
    den = f"CASE WHEN {is_('op-divide-error')} AND kind = 'mul' THEN 1 ELSE x END"
    first = is_("op-order-of-ops")
    product = f"CASE WHEN {is_('op-llm-product-misconception')} THEN said_value WHEN {is_('op-mult-sign-drop')} THEN abs(y * z) ELSE y * z + CASE WHEN {at('op-arith-slip', 's2')} THEN delta ELSE 0 END END"
    total = f"(CASE WHEN {first} THEN (x + y) * z ELSE x + ({product}) + CASE WHEN {at('op-arith-slip', 's3')} THEN delta ELSE 0 END END)"
    drop = is_("op-final-sign-drop")
    return f"""
  CASE WHEN linear THEN concat(x, 'x ', CASE WHEN y > 0 THEN '+' ELSE '-' END, ' ', abs(y), ' = ', z) ELSE concat(x, ' + ', {_paren('y')}, ' × ', {_paren('z')}) END AS s1,
  CASE WHEN linear AND {told} THEN concat(x, 'x = ', said_shown) WHEN linear THEN concat(x, 'x = ', z, CASE WHEN {minus} THEN ' - ' ELSE ' + ' END, abs(y))
       WHEN {first} THEN concat(x, ' + ', {_paren('y')}, ' = ', x + y) ELSE concat({_paren('y')}, ' × ', {_paren('z')}, ' = ', {product}) END AS s2,
  CASE WHEN linear THEN concat(x, 'x = ', {d}) WHEN {first} THEN concat({_paren('(x + y)')}, ' × ', {_paren('z')}, ' = ', {total}) ELSE concat(x, ' + ', {_paren(f'({product})')}, ' = ', {total}) END AS s3,
  CASE WHEN linear THEN concat('x = ', CASE WHEN {drop} THEN replace({_ratio(num, den)}, '-', '') ELSE {_ratio(num, den)} END) ELSE concat('答え ', CASE WHEN {drop} THEN abs({total}) ELSE {total} END) END AS s4"""


def _case(types: dict, k: int) -> str:
    return " ".join(f"WHEN '{op}' THEN {v[k]!r}" for op, v in types.items())


def proposal(domain: str, x: int, y: int, z: int) -> str:
    """A stand-in for a model that proposes misconceptions: on some rows allowed ones, on others such that the rules refuse, or a failure."""
    turn = (x + 2 * y + 3 * z) % 5
    if turn == 4:
        raise ValueError("no answer")
    if domain == P.LINEAR:
        return (f"{z} + {y}", f"{abs(y)} - {abs(z)}", f"{z} + {abs(y)} + 99", "about three")[turn] if y > 0 else (f"{z} - {-y}", f"{z} * {-y}", f"{z} - {y}", "x")[turn]
    return (str(abs(y * z)), f" +{y * z + 1}" if y * z + 1 >= 0 else str(y * z + 1), str(y * z + 900), "many")[turn]


#: The same in SQL: value, canonical form and whether the rules take it.
_TURN = "(((x + 2 * y + 3 * z) % 5 + 5) % 5)"
_SAID = f"""
  CASE WHEN NOT linear THEN CASE {_TURN} WHEN 0 THEN abs(y * z) WHEN 1 THEN y * z + 1 WHEN 2 THEN y * z + 900 END
       WHEN y > 0 THEN CASE {_TURN} WHEN 0 THEN z + y WHEN 1 THEN abs(y) - abs(z) END
       ELSE CASE {_TURN} WHEN 0 THEN z + y WHEN 1 THEN z * -y END END AS said_value,
  CASE WHEN y > 0 THEN CASE {_TURN} WHEN 0 THEN concat(z, ' + ', y) WHEN 1 THEN concat(abs(y), ' - ', abs(z)) END
       ELSE CASE {_TURN} WHEN 0 THEN concat(z, ' - ', -y) WHEN 1 THEN concat(z, ' × ', -y) END END AS said_shown"""
_TAKEN = "CASE WHEN linear THEN said_value <> z - y ELSE said_value <> y * z AND abs(said_value) <= abs(y * z) + 30 END"


def generated(proposals: bool = False) -> str:
    """CTEs up to ``rec``; numbers of records and errors are those of ``TABLE``."""
    types = P.LINEAR_TYPES | {f"a:{k}": v for k, v in P.ARITH_TYPES.items()}
    key = "CASE WHEN linear THEN op ELSE 'a:' || op END"
    clean = lambda i: f"CASE WHEN site = '{i}' OR list_contains(affected, '{i}') THEN 0 ELSE 1 END"
    weight = lambda i: one_of([r[i] for r in P.RUBRICS], "rub")
    taken = f"coalesce({_TAKEN}, false)" if proposals else "false"
    return f"""
n AS (SELECT count(*) AS n, round_even(count(*) * 0.7, 0)::BIGINT AS e FROM {TABLE}),
i AS (SELECT unnest(range(e)) AS idx, n, e FROM n),
d AS (SELECT *, {_pick('domain', 2)} = 0 AS linear, {one_of([2, 3, 4, 5, -2, -3], _pick('a', 6))} AS la, {one_of(_NONZERO, _pick('b', 18))} AS lb, {_pick('c', 41)} - 20 AS lc FROM i),
p AS (SELECT idx, n, e, linear, CASE WHEN linear THEN la ELSE {one_of(_NONZERO, _pick('p', 18))} END AS x, CASE WHEN linear THEN lb ELSE {one_of(_NONZERO, _pick('q', 18))} END AS y,
  CASE WHEN NOT linear THEN {one_of(_NONZERO, _pick('r', 18))} WHEN {_pick('fraction', 1_000_000)} < 400000 THEN lc + CASE WHEN (lc - lb) % abs(la) = 0 THEN 1 ELSE 0 END ELSE la * ({_pick('root', 19)} - 9) + lb END AS z FROM d),
t AS (SELECT *, {_SAID} FROM p),
c AS (SELECT *, {taken} AS taken, {one_of([-2, -1, 1, 2], _pick('delta', 4))} AS slip, {one_of([-1, 1], _pick('off', 2))} AS off_by, CASE WHEN {_pick('kind', 2)} = 0 THEN 'mul' ELSE 'off' END AS how,
  CASE WHEN linear THEN list_filter(['op-transpose-sign', 'op-arith-slip', 'op-divide-error', CASE WHEN (z - y) * sign(x) < 0 THEN 'op-final-sign-drop' END], lambda o: o IS NOT NULL)
       ELSE list_filter(['op-arith-slip', CASE WHEN y * z < 0 THEN 'op-mult-sign-drop' END, CASE WHEN z <> 1 THEN 'op-order-of-ops' END, CASE WHEN x + y * z < 0 THEN 'op-final-sign-drop' END], lambda o: o IS NOT NULL) END AS ops FROM t),
o AS (SELECT *, ops[{_pick('mutation', 'len(ops)')} + 1] AS pre FROM c),
m AS (SELECT *, CASE WHEN taken AND linear THEN 'op-llm-transpose-misconception' WHEN taken THEN 'op-llm-product-misconception' WHEN pre = 'op-divide-error' AND how = 'mul' AND z = y THEN 'op-transpose-sign' ELSE pre END AS op FROM o),
w AS (SELECT *, how AS kind, CASE WHEN op = 'op-divide-error' THEN off_by ELSE slip END AS delta,
  CASE WHEN op IN ('op-transpose-sign', 'op-mult-sign-drop', 'op-order-of-ops', 'op-llm-transpose-misconception', 'op-llm-product-misconception') THEN 's2' WHEN op = 'op-arith-slip' AND NOT linear AND {_pick('slip_site', 2)} = 0 THEN 's2' WHEN op = 'op-arith-slip' THEN 's3' ELSE 's4' END AS site,
  {choose("(idx || CASE WHEN linear THEN '" + P.LINEAR + "' ELSE '" + P.ARITH + "' END)", 'rubric', len(P.RUBRICS))} AS rub, row_number() OVER (ORDER BY sha256('{SEED}|' || idx || '|twin'), idx) AS twin FROM m),
g AS (SELECT idx, [s1, s2, s3, s4] AS gold FROM (SELECT idx, {_texts('NULL')} FROM w)),
u AS (SELECT idx, [s1, s2, s3, s4] AS mutant FROM (SELECT idx, {_texts('op')} FROM w)),
f AS (SELECT w.*, gold, mutant, list_filter(['s2', 's3', 's4'], lambda s: s > site AND gold[substr(s, 2)::INT] <> mutant[substr(s, 2)::INT]) AS affected FROM w JOIN g USING (idx) JOIN u USING (idx)),
s AS (SELECT *, {weight(0)} AS w0, {weight(1)} AS w1, {weight(2)} AS w2, printf('math-g7-%s-%06d', CASE WHEN linear THEN 'lin' ELSE 'ar' END, idx) AS pair_id,
  CASE {key} {_case(types, 0)} END AS type, CASE {key} {_case(types, 1)} END AS severity, replace(replace(gold[4], 'x = ', ''), '答え ', '') AS answer_key,
  CASE WHEN linear THEN concat('次の方程式を解きなさい。 ', gold[1]) ELSE concat('次の計算をしなさい。 ', gold[1]) END AS problem FROM f),
a AS (SELECT *, w0 + (w1 * ({clean('s2')} + {clean('s3')})) // 2 + CASE WHEN gold[4] = mutant[4] THEN w2 ELSE 0 END AS points FROM s),
rec AS (SELECT * EXCLUDE (points), pair_id || '-e1' AS sample_id, false AS control, points AS awarded, concat_ws(chr(10), problem, array_to_string(mutant, chr(10))) AS transcript FROM a
  UNION ALL SELECT * EXCLUDE (points), pair_id || '-e0', true, 10, concat_ws(chr(10), problem, array_to_string(gold, chr(10))) FROM a WHERE twin <= least(n - e, e))"""


RECORDS = f"""WITH {generated()}
SELECT sample_id, pair_id, problem, answer_key, array_to_string(gold, ' | ') AS gold, CASE WHEN control THEN '' ELSE array_to_string(mutant, ' | ') END AS mutant, CASE WHEN NOT control THEN op END AS operator, CASE WHEN NOT control THEN type END AS type,
  CASE WHEN NOT control THEN severity END AS severity, CASE WHEN NOT control THEN site END AS site, CASE WHEN NOT control THEN array_to_string(affected, ',') END AS affected, awarded::INT AS awarded,
  concat('rb-', CASE WHEN linear THEN 'lin' ELSE 'ar' END, '-w', w0, w1, w2) AS rubric, transcript FROM rec"""
PROPOSED = RECORDS.replace(generated(), generated(True))
STATS = f"WITH {generated()}, q AS (SELECT *, gold[substr(site, 2)::INT] <> mutant[substr(site, 2)::INT] AND len(list_filter(range(1, 5), lambda k: gold[k] <> mutant[k] AND k < substr(site, 2)::INT)) = 0 AS fine FROM rec) SELECT count(*) AS n_generated, count(*) AS g1_pass, 0::BIGINT AS g1_fail, count(*) FILTER (WHERE control OR fine) AS g2_pass, count(*) FILTER (WHERE NOT control AND NOT fine) AS g2_fail, round(count(*) FILTER (WHERE control) / count(*) FILTER (WHERE control OR fine), 6) AS control_ratio FROM q"
OPERATORS = f"WITH {generated()} SELECT CASE WHEN control THEN '(control)' ELSE op END AS operator, count(*) AS n FROM rec GROUP BY 1"

#: Labels of error records by the relabelling rules, on records with proposals. ``flip``: the gold step with its binary sign turned.
RELABELLED = f"""{generated(True)},
l0 AS (SELECT *, concat(x, 'x = ', z, CASE WHEN y > 0 THEN ' + ' ELSE ' - ' END, abs(y)) AS flip FROM rec WHERE NOT control),
l1 AS (SELECT *, CASE WHEN op = 'op-llm-transpose-misconception' THEN CASE WHEN replace(flip, ' ', '') = replace(mutant[2], ' ', '') THEN 'equivalent' ELSE 'subtype_retained' END
   WHEN op = 'op-llm-product-misconception' THEN CASE WHEN y * z < 0 AND said_value = abs(y * z) THEN 'negative_equivalent' WHEN y * z > 0 THEN 'positive_false_identifiable' ELSE 'subtype_retained' END END AS bucket FROM l0),
l2 AS (SELECT *, CASE WHEN op = 'op-transpose-sign' OR bucket = 'equivalent' THEN '移項' WHEN op = 'op-mult-sign-drop' OR bucket IN ('negative_equivalent', 'positive_false_identifiable') THEN '符号・乗算' END AS coarse,
   op = 'op-llm-product-misconception' AND abs(said_value - y * z) IN (1, 2) AS near, op = 'op-arith-slip' AND site = 's2' AND NOT linear AS slips FROM l1),
lab AS (SELECT sample_id, coalesce(coarse, type) AS type_identifiable, coalesce(bucket = 'subtype_retained', false) AS subtype_retained, near OR slips AS ambiguous_cross_family, type AS type_legacy, op AS operator, bucket, coarse IS NOT NULL AS unidentifiable, near, slips FROM l2)"""
LABELS = f"WITH {RELABELLED} SELECT sample_id, type_identifiable, subtype_retained, ambiguous_cross_family, type_legacy, operator, bucket, unidentifiable FROM lab"
LABEL_STATS = f"""WITH {RELABELLED} SELECT count(*) AS n_error_records, count(*) FILTER (WHERE unidentifiable) AS n_unidentifiable, round(avg(subtype_retained::INT), 6) AS subtype_coverage,
  {', '.join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in ('equivalent', 'negative_equivalent', 'positive_false_identifiable', 'subtype_retained'))},
  count(*) FILTER (WHERE near) AS ambiguous_product, count(*) FILTER (WHERE slips) AS ambiguous_arith, count(*) FILTER (WHERE ambiguous_cross_family) AS ambiguous, count(*) FILTER (WHERE unidentifiable AND subtype_retained) = 0 AS healthy FROM lab"""

_KINDS = [*ALL_TYPES, *FAMILY, "移項", "符号・乗算"]

_STRANGE = "次の方程式を解きなさい。計算し答え×"
#: White space out, other characters than ASCII to letters that no text holds: distances in bytes are then those in characters.
norm = lambda t: rf"translate(regexp_replace({t}, '\s', '', 'g'), '{_STRANGE}', '{''.join(map(chr, range(65, 65 + len(_STRANGE))))}')"
_lev = "levenshtein"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: What a mediocre reader would answer, by the record's index k: columns of ``said``. The truth's box is 120 by 44 pixels.
ANSWERS = f"""
k0 AS (SELECT *, idx AS k, CASE WHEN control THEN '' ELSE type END AS truth, concat_ws(chr(10), problem, array_to_string(gold, chr(10))) AS right_text FROM rec),
said AS (SELECT *, k % 11 = 0 AS failed, 100 + k % 300 AS bx, 200 + k % 200 AS by, k % 7 * 10 AS off,
  CASE WHEN control AND k % 3 <> 0 THEN 0 WHEN k % 5 = 1 THEN 0 WHEN k % 5 = 2 THEN 2 ELSE 1 END AS shown,
  CASE WHEN k % 4 = 0 THEN 's1' WHEN control THEN 's3' ELSE site END AS step, CASE WHEN k % 2 = 1 OR control THEN {_list(_KINDS)}[k % {len(_KINDS)} + 1] ELSE truth END AS kind_said,
  CASE k % 6 WHEN 1 THEN substr(transcript, 1, length(transcript) - 3) WHEN 2 THEN transcript || 'zz' WHEN 3 THEN right_text WHEN 4 THEN '' WHEN 5 THEN replace(transcript, ' ', '  ') ELSE transcript END AS read,
  CASE WHEN k % 9 > 0 THEN awarded + k % 4 - 1 END AS told, CASE WHEN k % 13 > 0 THEN CASE k % 3 WHEN 0 THEN [truth] WHEN 1 THEN [] ELSE {_list(ALL_TYPES)} END END AS refs FROM k0)"""


def _measured(source: str, text: str) -> str:
    """CTEs ``near`` and ``met``: ``source`` with the error rate of ``text`` and whether it over-corrects."""
    return f"""
near AS (SELECT *, {norm('transcript')} AS ref, {norm(text)} AS hyp, {norm('gold[substr(site, 2)::INT]')} AS gs, {norm('mutant[substr(site, 2)::INT]')} AS ms, list_filter(list_transform(string_split({text}, chr(10)), lambda l: {norm('l')}), lambda l: l <> '') AS ls FROM {source}),
met AS (SELECT *, {_lev}(ref, hyp) / length(ref) AS cer, CASE WHEN len(ls) > 0 THEN list_sort([{{'d': least({_lev}(ls[q], gs), {_lev}(ls[q], ms)), 'q': q}} FOR q IN range(1, len(ls) + 1)])[1].q END AS nq FROM near),
over AS (SELECT *, NOT control AND gs <> ms AND coalesce({_lev}(ls[nq], gs) < {_lev}(ls[nq], ms), false) AS over_corrected FROM met)"""


_RESULT = f"""{_measured('said', 'read')},
res AS (SELECT sample_id, failed, NOT control AS has_error, shown > 0 AS detected, cer, over_corrected, CASE WHEN NOT control AND shown > 0 THEN (120.0 - off) / (120 + off) END AS iou, truth, kind_said, shown, awarded, told, op FROM over)"""
RESULTS = f"""WITH {generated()}, {ANSWERS}, {_RESULT}
SELECT sample_id, failed AS parse_failure, has_error, CASE WHEN NOT failed THEN detected END AS detected_error, CASE WHEN NOT failed THEN detected = has_error END AS detection_correct, CASE WHEN NOT failed THEN round(cer, 6) END AS transcript_cer,
  CASE WHEN NOT failed AND has_error THEN over_corrected END AS over_correction, CASE WHEN NOT failed THEN round(iou, 6) END AS bbox_iou, CASE WHEN NOT failed THEN iou >= 0.5 END AS bbox_iou_at_0_5,
  CASE WHEN failed THEN NULL WHEN has_error THEN truth || '=' || (shown > 0 AND kind_said = truth) ELSE '' END AS hits, CASE WHEN NOT failed THEN told IS NOT DISTINCT FROM awarded END AS score_exact_match, CASE WHEN NOT failed THEN coalesce(abs(told - awarded) <= 1, false) END AS score_within_1 FROM res"""
_RATED = """avg(CASE WHEN has_error THEN detected::INT END) AS tpr, avg(CASE WHEN NOT has_error THEN (NOT detected)::INT END) AS tnr, count(*) FILTER (WHERE has_error) AS n_error_records, count(*) FILTER (WHERE NOT has_error) AS n_control_records,
  avg(cer) AS transcript_cer_mean, median(cer) AS transcript_cer_median, avg(CASE WHEN has_error THEN over_corrected::INT END) AS over_correction_rate, avg(iou) AS bbox_iou_mean, avg((iou >= 0.5)::INT) AS iou_at_0_5, avg((told IS NOT DISTINCT FROM awarded)::INT) AS score_exact_match,
  avg(coalesce(abs(told - awarded) <= 1, false)::INT) AS score_within_1, count(iou) AS n_location_records"""
_SUMMED = ", ".join(f"round({c}, 6) AS {c}" for c in ("tpr", "tnr", "transcript_cer_mean", "transcript_cer_median", "over_correction_rate", "bbox_iou_mean", "iou_at_0_5", "score_exact_match", "score_within_1"))
SUMMARY = f"""WITH {generated()}, {ANSWERS}, {_RESULT}, ok AS (SELECT * FROM res WHERE NOT failed), rated AS (SELECT {_RATED} FROM ok),
h AS (SELECT avg(a) AS macro, count(*) AS n_classes FROM (SELECT truth, avg((shown > 0 AND kind_said = truth)::INT) AS a FROM ok WHERE has_error GROUP BY truth))
SELECT {_SUMMED}, round((tpr + tnr) / 2, 6) AS bacc, round(1 - tnr, 6) AS hallucinated_error_rate, n_error_records, n_control_records, n_location_records, round(macro, 6) AS type_macro_exact_match, n_classes, (SELECT count(*) FILTER (WHERE failed) FROM res) AS n_parse_failures, (SELECT count(*) FROM res) AS n_results FROM rated, h"""


def _family(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY.items()) + f" ELSE {kind} END"


_FAMILIES, _SUBTYPES = "('移項', '符号・乗算')", "(" + ", ".join(f"'{k}'" for k in FAMILY) + ")"


def identifiable(coarsen: bool) -> str:
    """The summary's part on types, where records carry their relabelled type."""
    kind = f"CASE WHEN t IN {_FAMILIES} THEN {_family('kind_said')} ELSE kind_said END" if coarsen else "kind_said"
    return f"""WITH {RELABELLED}, {ANSWERS}, e AS (SELECT said.*, lab.type_identifiable AS t, lab.subtype_retained AS kept, lab.ambiguous_cross_family AS vague FROM said JOIN lab USING (sample_id) WHERE NOT failed),
h0 AS (SELECT *, CASE WHEN shown > 0 THEN {kind} END AS one FROM e),
h1 AS (SELECT *, t IN {_FAMILIES} AND coalesce(one IN {_SUBTYPES} AND {_family('one')} = t, false) AS over FROM h0), h2 AS (SELECT *, coalesce(one = t, false) AND NOT over AS hit FROM h1)
SELECT (SELECT round(avg(a), 6) FROM (SELECT avg(hit::INT) AS a FROM h2 WHERE NOT vague GROUP BY t)) AS type_macro_exact_match, round(avg(CASE WHEN NOT vague AND t IN {_FAMILIES} THEN over::INT END), 6) AS over_claim_rate, count(*) FILTER (WHERE vague) AS ambiguous_cross_family_excluded,
  round(avg(kept::INT), 6) AS subtype_coverage, count(*) FILTER (WHERE kept) AS subtype_gt_count, count(*) FILTER (WHERE NOT vague) AS type_metric_n FROM h2"""


def _rewards(source: str, labelled: bool) -> str:
    """CTEs up to ``rew`` from rows with cer, over_corrected, ok, n_said, best, step_ok, kinds, told, refs, truth, control, awarded (label, vague)."""
    head = lambda k: f"split_part({k}, '/', 1)"
    legacy = f"CASE WHEN list_contains(kinds, truth) THEN 1.0 WHEN len(list_filter(kinds, lambda q: q <> '' AND {head('q')} = {head('truth')})) > 0 THEN 0.5 ELSE 0.0 END"
    over = f"len(list_filter(kinds, lambda q: q IN {_SUBTYPES} AND {_family('q')} = label)) > 0"
    fine = f"CASE WHEN vague THEN 0.0 WHEN label IN {_FAMILIES} THEN CASE WHEN {over} THEN 0.0 WHEN list_contains(kinds, label) THEN 1.0 ELSE 0.0 END WHEN list_contains(kinds, label) THEN 1.0 WHEN label IN {_SUBTYPES} AND list_contains(kinds, {_family('label')}) THEN 0.5 ELSE 0.0 END"
    w = WEIGHTS
    whole = " + ".join(f"{w[k]} * r_{k}" for k in w)
    rest = " + ".join(f"{w[k]} * r_{k}" for k in w if k != "type")
    return f"""
v0 AS (SELECT *, greatest(0, 1 - cer) AS faithful, list_distinct(coalesce(refs, [])) AS named, (CASE WHEN control THEN [] ELSE [truth] END)::VARCHAR[] AS due FROM {source}),
v1 AS (SELECT *, len(list_intersect(named::VARCHAR[], due))::DOUBLE AS common FROM v0),
v2 AS (SELECT *, CASE WHEN over_corrected THEN greatest(0, faithful - 0.8) ELSE faithful END AS r_transcript, CASE WHEN control THEN (n_said = 0)::INT ELSE greatest(0, (n_said > 0)::INT - 0.25 * greatest(0, n_said - 1)) END AS r_detection,
  CASE WHEN control THEN (n_said = 0)::INT WHEN n_said = 0 THEN 0 ELSE 0.5 * CASE WHEN best >= 0.5 THEN 1 ELSE best END + 0.5 * step_ok::INT END AS r_location, CASE WHEN control THEN (n_said = 0)::INT WHEN n_said = 0 THEN 0 ELSE {fine if labelled else legacy} END AS r_type,
  CASE WHEN told = awarded THEN 1 WHEN abs(told - awarded) <= 1 THEN 0.5 ELSE 0 END AS r_score,
  CASE WHEN len(due) = 0 AND len(named) = 0 THEN 1 WHEN len(due) > 0 AND len(named) > 0 THEN CASE WHEN common > 0 THEN 1.25 * (common / len(named)) * (common / len(due)) / (0.25 * common / len(named) + common / len(due)) ELSE 0 END * CASE WHEN len(named) > 2 * greatest(1, len(due)) THEN 0.2 ELSE 1 END ELSE 0 END AS r_comment,
  1 AS r_format, {'vague AND NOT control' if labelled else 'false'} AS excluded FROM v1),
rew AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN excluded THEN ({rest}) / (1 - {w['type']}) ELSE {whole} END AS total FROM v2)"""


_PARTS = ", ".join(f"round(CASE WHEN ok THEN r_{k} ELSE 0 END, 6) AS {k}" for k in WEIGHTS)
_ANSWERED = "SELECT *, NOT failed AS ok, shown AS n_said, (120.0 - off) / (120 + off) AS best, ((step IS NOT DISTINCT FROM site AND shown > 0) OR (shown = 2 AND site = 's4')) AS step_ok, (CASE shown WHEN 0 THEN [] WHEN 1 THEN [kind_said] ELSE [kind_said, ''] END)::VARCHAR[] AS kinds FROM over"
REWARDS = f"WITH {generated()}, {ANSWERS}, {_measured('said', 'read')}, ans AS ({_ANSWERED}), {_rewards('ans', False)} SELECT sample_id, {_PARTS}, round(total, 6) AS total FROM rew"
REWARDS_LABELLED = f"WITH {RELABELLED}, {ANSWERS}, {_measured('said', 'read')}, ans AS (SELECT o.*, lab.type_identifiable AS label, coalesce(lab.ambiguous_cross_family, false) AS vague FROM ({_ANSWERED}) o LEFT JOIN lab USING (sample_id)), {_rewards('ans', True)} SELECT sample_id, {_PARTS}, round(total, 6) AS total FROM rew"

#: Answers that try to earn without reading, as changes to the perfect one.
_jitter = lambda i: f"({choose('sample_id', f'box{i}', 7, 6)} - 3)"
_BAD = {
    "perfect": {}, "empty_transcript": {"read": "''"}, "error_spam": {"n": "5"}, "giant_bbox": {"best": "120.0 * 44 / (1240 * 1754)"}, "duplicate_refs": {"n": "4"}, "over_correct": {"read": "right_text"},
    "miss_and_full_score": {"n": "0", "told": "10", "refs": "[]"}, "comment_stuffing": {"refs": _list(ALL_TYPES)}, "empty_but_valid_json": {"read": "''", "n": "0", "told": "0", "refs": "[]"},
}
_LIE = {"n": "1", "told": "greatest(0, awarded - 2)", "refs": "['計算/加減']"}


def _tried(name: str, new: dict, where: str) -> str:
    base = {"read": "transcript", "n": "CASE WHEN control THEN 0 ELSE 1 END", "best": "shaken", "told": "awarded", "refs": "(CASE WHEN control THEN [] ELSE [type] END)"} | new
    return f"SELECT k0.* EXCLUDE (k), '{name}' AS family, {base['read']} AS read, {base['n']} AS n_said, {base['best']} AS best, {base['told']} AS told, ({base['refs']})::VARCHAR[] AS refs FROM k1 AS k0 WHERE {where}"


_SIDE = lambda lo, hi, size: f"greatest(0, least({size}, {size} + {hi}) - greatest(0, {lo}))"
INVERSIONS = f"""WITH {generated()}, {ANSWERS.split('said AS')[0].rstrip().rstrip(',')},
k2 AS (SELECT *, {_jitter(0)} AS j0, {_jitter(1)} AS j1, {_jitter(2)} AS j2, {_jitter(3)} AS j3 FROM k0), k3 AS (SELECT *, {_SIDE('j0', 'j2', 120)} * {_SIDE('j1', 'j3', 44)} AS inter FROM k2),
k1 AS (SELECT * EXCLUDE (j0, j1, j2, j3, inter), inter::DOUBLE / (120 * 44 + (120 + j2 - j0) * (44 + j3 - j1) - inter) AS shaken FROM k3),
tried AS ({' UNION ALL '.join([*(_tried(k, v, 'NOT control' if k != 'perfect' else 'true') for k, v in _BAD.items()), _tried('hallucinate_on_control', _LIE, 'control')])}),
{_measured('tried', 'read')}, ans AS (SELECT *, true AS ok, true AS step_ok, (CASE WHEN n_said = 0 OR control THEN [] ELSE [type] END)::VARCHAR[] AS kinds FROM over), {_rewards('ans', False)},
gap AS (SELECT b.family, b.total - v.total AS gap FROM rew b JOIN rew v ON v.sample_id = b.sample_id AND v.family = 'perfect' WHERE b.family <> 'perfect')
SELECT family, count(*) AS n, count(*) FILTER (WHERE gap > 1e-12) AS n_inversions, round(max(gap), 6) AS max_gap, round(count(*) FILTER (WHERE gap > 1e-12) / count(*), 6) AS inversion_rate FROM gap GROUP BY GROUPING SETS ((family), ())"""

# Dataset build

_COORDINATES = "座標は左上原点の 0〜1000 の相対座標 [x0,y0,x1,y1] で答えてください。"
_rel = lambda v, size: f"greatest(0, least(1000, round_even(({v}) * 1000.0 / {size}, 0)))::INT"
_json = lambda t: f"replace({t}, chr(10), '\\n')"
_USER = f"""concat(problem, chr(10), chr(10), '模範解答:', chr(10), concat_ws(chr(10), '- s1: ' || gold[1], '- s2: ' || gold[2], '- s3: ' || gold[3], '- s4: ' || gold[4]), chr(10), chr(10),
  '採点基準:立式 ', w0, ' 点、', CASE WHEN linear THEN '変形過程' ELSE '途中の計算' END, ' ', w1, ' 点、最終解 ', w2, ' 点(計 10 点)', chr(10), chr(10), '{_COORDINATES}')"""
_TEACHER = f"""concat('{{"transcript":"', {_json('transcript')}, '","errors":[', CASE WHEN control THEN '' ELSE concat('{{"step_id":"', site, '","bbox":[', {_rel('bx', 1240)}, ',', {_rel('"by"', 1754)}, ',', {_rel('bx + 120', 1240)}, ',', {_rel('"by" + 44', 1754)}, '],"type":"', type, '"}}') END, '],"score":', awarded, '}}')"""
_PLACED = "b0 AS (SELECT *, idx AS k, 100 + idx % 300 AS bx, 200 + idx % 200 AS \"by\" FROM rec)"
#: Which split a pair goes to: those of five test records, a tenth of the others to val.
_SPLIT = f"""tp AS (SELECT DISTINCT pair_id FROM (SELECT sample_id, pair_id FROM rec ORDER BY sha256('4|' || sample_id), sample_id LIMIT 5)),
rp AS (SELECT pair_id, row_number() OVER (ORDER BY sha256('3|' || pair_id), pair_id) AS place, count(*) OVER () AS rest FROM (SELECT DISTINCT pair_id FROM rec) WHERE pair_id NOT IN (SELECT pair_id FROM tp)),
sp AS (SELECT r.sample_id, CASE WHEN rp.pair_id IS NULL THEN 'test' WHEN place <= round_even(rest * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM rec r LEFT JOIN rp ON rp.pair_id = r.pair_id)"""
TUNING = f"""WITH {generated()}, {_PLACED}, {_SPLIT} SELECT sample_id AS id, 'images/' || sample_id || '.png' AS image, {_USER} AS asked, {_TEACHER} AS answered, pair_id, CASE WHEN linear THEN '{P.LINEAR}' ELSE '{P.ARITH}' END AS domain, CASE WHEN NOT control THEN op END AS operator, control AS error_free, split FROM b0 JOIN sp USING (sample_id)"""
SPLITS = f"""WITH {generated()}, {_SPLIT} SELECT split, count(*) AS records, count(DISTINCT pair_id) AS pairs, count(*) FILTER (WHERE NOT control) AS error_records, count(*) FILTER (WHERE control) AS control_records, round(count(*) FILTER (WHERE NOT control) / nullif(count(*) FILTER (WHERE control), 0), 6) AS error_to_control_ratio FROM rec JOIN sp USING (sample_id) GROUP BY GROUPING SETS ((split), ())"""
#: What is wrong with each of a batch of spoilt records, by the index.
REJECTS = f"""WITH {generated()} SELECT pair_id || CASE WHEN control THEN '-e0' ELSE '-e1' END AS was, array_to_string(list_filter([CASE WHEN idx % 10 = 0 THEN 'empty sample_id' END, CASE WHEN idx % 10 = 1 THEN 'empty pair_id' END, CASE WHEN idx % 10 = 2 THEN 'bad page size' END, CASE WHEN idx % 10 = 3 THEN 'no span boxes' END,
  CASE WHEN idx % 10 = 4 AND NOT control THEN 'bad box' END, CASE WHEN idx % 10 IN (3, 4, 5) AND NOT control THEN 'error without a box' END, CASE WHEN idx % 10 = 6 THEN 'no transcript' END, CASE WHEN idx % 10 = 7 AND NOT control THEN 'error_free with errors' END, CASE WHEN idx % 10 = 7 AND control THEN 'errors expected' END,
  CASE WHEN idx % 10 = 0 OR idx % 10 = 8 THEN 'duplicate sample_id' END], lambda r: r IS NOT NULL), ',') AS reasons FROM rec, (SELECT unnest(range(2)) AS copy) WHERE copy = 0 OR idx % 10 = 8"""
STYLES = f"WITH {generated()}, s1 AS (SELECT pair_id, count(DISTINCT CASE WHEN control AND idx % 7 = 0 THEN 'style-other' ELSE 'style-' || substr(sha256(pair_id), 1, 8) END) AS k FROM rec GROUP BY pair_id) SELECT count(*) AS n_pairs, count(*) FILTER (WHERE k = 1) AS n_same FROM s1"
ACCEPTANCE = f"WITH {generated()}, f0 AS (SELECT idx FROM rec WHERE NOT control ORDER BY sample_id LIMIT 100) SELECT count(*) AS n, count(*) FILTER (WHERE idx % 9 > 0) AS n_boxed, bool_and(idx % 9 > 0) AS accepted FROM f0"

#: Wording by a verbaliser that fails on steps whose first number is a multiple of three.
_first = lambda t: f"regexp_extract({t}, '-?\\d+')"
_worded = lambda t: f"CASE WHEN {_first(t)}::BIGINT % 3 = 0 THEN {t} ELSE concat('つまり ', {_first(t)}, ' を使うと、', {t}) END"
_fell = lambda steps, keep: f"array_to_string([['s1', 's2', 's3', 's4'][q] FOR q IN range(1, 5) IF {_first(f'{steps}[q]')}::BIGINT % 3 = 0 AND {keep}], ',')"
VERBALISED = f"""WITH {generated()}, w1 AS (SELECT *, [{', '.join(_worded(f'gold[{q}]') for q in range(1, 5))}] AS gs, [{', '.join(f"CASE WHEN site = 's{q}' OR list_contains(affected, 's{q}') THEN {_worded(f'mutant[{q}]')} ELSE {_worded(f'gold[{q}]')} END" for q in range(1, 5))}] AS ms,
  {_fell('gold', 'true')} AS gf, CASE WHEN control THEN '' ELSE {_fell('mutant', "(site = ['s1', 's2', 's3', 's4'][q] OR list_contains(affected, ['s1', 's2', 's3', 's4'][q]))")} END AS mf FROM rec)
SELECT sample_id, array_to_string(gs, ' | ') AS gold, CASE WHEN control THEN '' ELSE array_to_string(ms, ' | ') END AS mutant, concat(problem, chr(10), array_to_string(CASE WHEN control THEN gs ELSE ms END, chr(10))) AS transcript,
  CASE WHEN gf = '' AND mf = '' THEN 'llm' ELSE concat('llm+fallback(', array_to_string(list_filter([CASE WHEN gf <> '' THEN 'gold:' || gf END, CASE WHEN mf <> '' THEN 'mut:' || mf END], lambda v: v IS NOT NULL), '|'), ')') END AS verbalizer FROM w1"""

#: Boxes of all characters, cells by the alignment along the span between the common beginning and end of gold and mutant.
CHARACTERS = f"""WITH {generated()},
y0 AS (SELECT sample_id, pair_id, control, site, gold, [problem] || CASE WHEN control THEN gold ELSE mutant END AS lines FROM rec),
y1 AS (SELECT *, unnest(lines) AS t, generate_subscripts(lines, 1) AS ln FROM y0),
y2 AS (SELECT *, CASE WHEN NOT control AND ln > 1 AND site = 's' || (ln - 1) THEN gold[ln - 1] END AS g, CASE WHEN ln = 1 THEN 20 ELSE 19 END AS per, CASE WHEN ln = 1 THEN 150 ELSE 210 END AS x0, length(t) AS len FROM y1),
y3 AS (SELECT *, length(g) AS glen, CASE WHEN g IS NOT NULL THEN list_max([q FOR q IN range(0, least(len, length(g)) + 1) IF substr(t, 1, q) = substr(g, 1, q)]) END AS head FROM y2),
y4 AS (SELECT *, CASE WHEN g IS NOT NULL THEN list_max([q FOR q IN range(0, least(len, glen) - head + 1) IF substr(t, len - q + 1) = substr(g, glen - q + 1)]) END AS tail FROM y3),
y5 AS (SELECT *, least(head, len - 1) AS lo, greatest(len - tail, least(head, len - 1) + 1) AS hi FROM y4),
y6 AS (SELECT *, unnest(range(len)) AS i FROM y5),
y7 AS (SELECT *, CASE WHEN g IS NULL OR i < lo THEN i WHEN i >= hi THEN i - (len - glen) ELSE lo + least(i - lo, greatest(0, glen - (len - hi) - lo - 1)) END AS cell FROM y6),
y8 AS (SELECT sample_id, ln, max(cell // per) + 1 AS tall FROM y7 GROUP BY ALL),
y9 AS (SELECT sample_id, ln, coalesce(sum(tall) OVER (PARTITION BY sample_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM y8)
SELECT sample_id, 's' || (ln - 1) AS step_id, i::INT AS i, (cell // per)::INT AS row_no, substr(t, i + 1, 1) AS char, round((x0 + cell % per * 46.2)::DOUBLE, 4) AS b0, round((140 + 96 * (above + cell // per))::DOUBLE, 4) AS b1, round((x0 + cell % per * 46.2 + 44)::DOUBLE, 4) AS b2, round((140 + 96 * (above + cell // per) + 44)::DOUBLE, 4) AS b3
FROM y7 JOIN y9 USING (sample_id, ln) WHERE ln > 1 AND substr(t, i + 1, 1) <> ' '"""

#: Does the text alone tell errors from controls: trained on one part of the pairs, rated on the other.
PROBE = f"""WITH {generated()}, x0 AS (SELECT sample_id, pair_id, NOT control AS y, regexp_replace(transcript, '\\s', '', 'g') AS t FROM rec),
xp AS (SELECT pair_id, row_number() OVER (ORDER BY sha256('2|' || pair_id), pair_id) <= round_even(count(*) OVER () * 0.3, 0) AS held FROM (SELECT DISTINCT pair_id FROM rec)),
x1 AS (SELECT x0.*, held FROM x0 JOIN xp USING (pair_id)), x2 AS (SELECT sample_id, y, held, unnest([substr(t, q, 2) FOR q IN range(1, length(t))]) AS b FROM x1),
xc AS (SELECT b, count(*) FILTER (WHERE y) AS c1, count(*) FILTER (WHERE NOT y) AS c0 FROM x2 WHERE NOT held GROUP BY b), xt AS (SELECT sum(c1) AS t1, sum(c0) AS t0, count(*) + 1 AS v FROM xc),
xs AS (SELECT sample_id, any_value(y) AS y, sum(ln((coalesce(c1, 0) + 1) / (t1 + v)) - ln((coalesce(c0, 0) + 1) / (t0 + v))) AS s FROM x2 LEFT JOIN xc USING (b), xt WHERE held GROUP BY sample_id),
xr AS (SELECT y, round(s, 9) AS s FROM xs), xk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM xr)
SELECT round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS auc, count(*) FILTER (WHERE y) AS n_pos, count(*) FILTER (WHERE NOT y) AS n_neg FROM xk"""

# Fault injection

_tok = lambda t: f"regexp_extract_all({t}, '-?\\d+')"
_put = lambda at, new: f"[CASE WHEN q = {at} THEN {new} ELSE gold[q] END FOR q IN range(1, 5)]"
INJECTED = f"""{generated()},
j0 AS (SELECT idx, linear, gold, {_pick('step', 4)} + 1 AS step, flatten([{', '.join(_tok(f'gold[{q}]') for q in range(1, 5))}]) AS known FROM s),
j1 AS (SELECT *, gold[step] AS t, known[{_pick('token', 'len(known)')} + 1] AS tk, {_pick('flip', 2)} = 0 AS plain, [q FOR q IN range(1, length(gold[step]) + 1) IF regexp_matches(substr(gold[step], q, 1), '[0-9]')] AS digits, [q FOR q IN range(1, 5) IF regexp_matches(gold[q], '-[0-9]')] AS minuses FROM j0),
j2 AS (SELECT *, CASE WHEN plain THEN tk WHEN starts_with(tk, '-') THEN substr(tk, 2) ELSE '-' || tk END AS token, digits[{_pick('digit', 'len(digits)')} + 1] AS at_digit, minuses[{_pick('minus', 'greatest(1, len(minuses))')} + 1] AS target FROM j1),
j3 AS (SELECT *, concat(substr(t, 1, at_digit - 1), (substr(t, at_digit, 1)::INT + 1 + {_pick('by', 8)}) % 10, substr(t, at_digit + 1)) AS altered,
  concat({one_of(['よって ', 'したがって ', 'ゆえに '], _pick('word', 3))}, t) AS benign, concat([concat('両辺から ', token, ' を引くと、'), concat('両辺を ', token, ' で割って、'), concat('左辺の ', token, ' を消すために、')][{_pick('clause', 3)} + 1], t) AS wordy FROM j2),
j4 AS (SELECT idx, linear, gold, known, 'clean' AS arm, gold AS texts FROM j3 UNION ALL SELECT idx, linear, gold, known, 'benign_paraphrase', {_put('step', 'benign')} FROM j3 UNION ALL SELECT idx, linear, gold, known, 'verbose_faithful', {_put('step', 'wordy')} FROM j3
  UNION ALL SELECT idx, linear, gold, known, 'digit_change', {_put('step', 'altered')} FROM j3 UNION ALL SELECT idx, linear, gold, known, 'minus_drop', CASE WHEN len(minuses) > 0 THEN {_put('target', "regexp_replace(gold[target], '-([0-9])', '\\1')")} ELSE {_put('step', 'altered')} END FROM j3),
j5 AS (SELECT *, [q FOR q IN range(1, 5) IF len(list_filter({_tok('texts[q]')}, lambda v: NOT list_contains(known, v) AND NOT list_contains(known, CASE WHEN starts_with(v, '-') THEN substr(v, 2) ELSE '-' || v END))) > 0
  OR CASE WHEN NOT linear AND q = 4 THEN NOT list_contains({_tok('texts[q]')}, {_tok('gold[q]')}[1]) ELSE NOT contains(replace(texts[q], ' ', ''), replace(gold[q], ' ', '')) END] AS failing FROM j4)"""
TEXTS = f"WITH {INJECTED} SELECT idx, arm, array_to_string(texts, ' | ') AS texts, array_to_string(list_transform(failing, lambda q: 's' || q), ',') AS failing FROM j5"
EFFICACY = f"WITH {INJECTED} SELECT arm, count(*) AS n, count(*) FILTER (WHERE len(failing) > 0) AS n_flagged, round(avg((len(failing) > 0)::INT), 6) AS flagged_rate FROM j5 GROUP BY arm"
