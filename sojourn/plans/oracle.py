"""DuckDB statements that answer the registered queries independently.

They use other means than the library where there are any: windows over exploded tokens instead
of array folds, engine quantiles instead of ranked counts. ``statements()`` joins each final
SELECT with the common table expressions that it needs.
"""

from __future__ import annotations

import re

from sojourn import schema as S
from sojourn.functions.seeded import poisson_cuts
from sojourn.functions.tokens import text
from sojourn.plans import registry as R
from sojourn.plans import views as V

LIMITS = V.LIMITS
EVENT_SORT = ", ".join(f"{c} NULLS FIRST" for c in S.EVENT_ORDER)


def md5_of(seed, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'"] + [f"cast({k} AS varchar)" for k in keys])
    return f"md5({parts})"


def hash32(seed, *keys: str) -> str:
    return f"cast('0x' || substr({md5_of(seed, *keys)}, 1, 8) AS bigint)"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(v if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def case(pairs, otherwise="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def targets_hit(token: str, targets) -> str:
    return "(" + " OR ".join(f"contains({token}, '{t}')" for t in targets) + ")"


def in_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


VISIT_NAME = case(
    (f"o_orderpriority LIKE '{d}%'", f"'{v}'") for d, v in V.PRIORITY_VISITS.items()
)
KIND = "(list_position([{}], event_type) - 1)".format(", ".join(f"'{k}'" for k in V.EVENT_KINDS))
EPOCH = "floor(epoch({}))"


def line_view(flag: str, concept: str, extra: str = "NULL") -> str:
    return f"""
    SELECT o_custkey AS person_id, l_shipdate AS moment, {concept} AS concept_id,
      cast({extra} AS double) AS value, l_orderkey AS visit_id, {VISIT_NAME} AS visit_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = '{flag}'"""


def branch(view: str, prefix: str, dated: bool = True, in_visit: bool = True) -> str:
    return f"""
    SELECT person_id AS subject_id, {EPOCH.format('moment') if dated else 'NULL::double'} AS time,
      '{prefix}' || concept_id AS code, {'value' if in_visit else 'NULL::double'} AS numeric_value,
      {'visit_id' if in_visit else 'NULL::bigint'} AS visit_id,
      {'visit_type' if in_visit else 'NULL::varchar'} AS visit_type FROM {view}"""


def person_branch(prefix: str, concept: str) -> str:
    return f"""
    SELECT person_id AS subject_id, NULL::double AS time, '{prefix}' || {concept} AS code,
      NULL::double AS numeric_value, NULL::bigint AS visit_id, NULL::varchar AS visit_type
    FROM person"""


def tokenised(source: str, learnt: str | None = None) -> str:
    """Token columns of an event relation, by windows; deciles are those of ``learnt``, or its own."""
    v = "coalesce(visit_id, 0)"
    gap = case(
        (f"gap >= {size}", f"'TIME_{unit}_' || least(gap // {size}, {top})")
        for unit, size, top in reversed(S.GAP_UNITS)
    )
    group = case(
        (f"visit_type IN ({', '.join(text(n) for n in names)})", f"'{g}'")
        for g, names in S.VISIT_GROUPS.items()
    )
    return f"""
    SELECT *, concat_ws(' ', time_token, visit_token, code, quantile_token, visit_end_token)
        AS event_text
    FROM (
      SELECT *, {gap} AS time_token,
        CASE WHEN numeric_value IS NOT NULL THEN
          'Q' || len(list_filter(breaks, lambda b: b < numeric_value)) END AS quantile_token,
        CASE WHEN vd <> 0 AND visit_type IS NOT NULL THEN coalesce({group}, 'Other') END
          AS visit_token,
        CASE WHEN vn <> 0 AND visit_id IS NOT NULL THEN 'VIEnd' END AS visit_end_token
      FROM (
        SELECT e.*, breaks, row_number() OVER w AS pos,
          cast(coalesce(floor((time - lag(time) OVER w) / 86400), 0) AS bigint) AS gap,
          {v} - lag({v}) OVER w AS vd, lead({v}) OVER w - {v} AS vn
        FROM {source} e LEFT JOIN (
          SELECT code, quantile_cont(numeric_value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS breaks
          FROM {learnt or source} WHERE numeric_value IS NOT NULL GROUP BY code) USING (code)
        WINDOW w AS (PARTITION BY subject_id ORDER BY {EVENT_SORT})))"""


def rounds(source: str, name: str, codes: int, low: int, high: int) -> dict[str, str]:
    """Two alternating code and subject filters of an event relation, literally."""
    out, last = {}, source
    for i in (1, 2):
        out[f"{name}_c{i}"] = f"""
    SELECT * FROM {last} WHERE code IN (
      SELECT code FROM {last} GROUP BY code HAVING count(DISTINCT subject_id) >= {codes})"""
        out[f"{name}_s{i}"] = f"""
    SELECT * FROM {name}_c{i} WHERE subject_id IN (
      SELECT subject_id FROM {name}_c{i} GROUP BY subject_id
      HAVING count(code) BETWEEN {low} AND {high})"""
        last = f"{name}_s{i}"
    out[name] = f"SELECT * FROM {last}"
    return out


def lists(order: str = "pos") -> str:
    return f"string_agg(event_text, ' ' ORDER BY {order})"


def ranked_split(relation: str, seed, fraction: str, key: str = "subject_id") -> str:
    return f"""
    SELECT {key}, CASE WHEN row_number() OVER (ORDER BY {md5_of(seed, key)})
        <= floor({fraction} * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
    FROM {relation}"""


FIXED = (
    sorted([*S.GAP_DAYS, S.NO_GAP]) + sorted(S.DECILE_TOKENS) + sorted(S.VISIT_GROUPS)
)

CTES: dict[str, str] = {
    "person": """
    SELECT c_custkey AS person_id, 8500 + c_custkey % 4 AS gender, 8600 + c_custkey % 3 AS sex,
      8700 + c_nationkey AS race,
      DATE '1940-01-01' + cast((c_custkey * 7919) % 18000 AS integer) AS moment FROM customer""",
    "visits": f"""
    SELECT o_custkey AS person_id, o_orderdate AS moment,
      9000 + cast(substr(o_orderpriority, 1, 1) AS bigint) AS concept_id, {VISIT_NAME} AS name
    FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'""",
    "conditions": line_view("R", "50000 + l_partkey % 40"),
    "procedures": line_view("A", "30000 + l_suppkey % 100"),
    "drugs": line_view("N", "70000 + l_partkey % 200", "l_quantity"),
    "measurements": f"""
    SELECT user_id AS person_id, ts AS moment, 20000 + {KIND} AS concept_id, value,
      user_id * 1000 + dayofmonth(ts) AS visit_id, 'Laboratory Visit' AS visit_type FROM events""",
    "ev_condition": branch("conditions", "CDzz"),
    "ev_procedure": branch("procedures", "PRzz"),
    "ev_measurement": branch("measurements", "MSzz"),
    "ev_drug": branch("drugs", "DRzz"),
    "ev_visit": branch("visits", "VSzz", in_visit=False),
    "ev_gender": person_branch("GENzz", "gender"),
    "ev_sex": person_branch("SEXzz", "sex"),
    "ev_race": person_branch("RACzz", "race"),
    "ev_birth": """
    SELECT person_id AS subject_id, epoch(moment::timestamp) AS time, 'MEDSzzBIRTH' AS code,
      NULL::double AS numeric_value, NULL::bigint AS visit_id, NULL::varchar AS visit_type
    FROM person""",
}
BRANCHES = ["condition", "procedure", "measurement", "drug", "visit", "gender", "sex", "race", "birth"]
CTES["ev"] = " UNION ALL ".join(f"SELECT * FROM ev_{b}" for b in BRANCHES)
CTES["ev_sample"] = " UNION ALL ".join(
    f"(SELECT * FROM ev_{b} ORDER BY subject_id, {EVENT_SORT} LIMIT {R.SAMPLE})" for b in BRANCHES
)
CTES["tok"] = tokenised("ev")
CTES |= rounds(
    "ev",
    "kept",
    LIMITS.min_subjects_per_code,
    LIMITS.min_events_per_subject,
    LIMITS.max_events_per_subject,
)
CTES |= rounds("ev", "two", 50, 40, 70)
CTES["kept_tok"] = tokenised("kept")
CTES["seqs"] = f"""
    SELECT subject_id, array_to_string(list_slice(string_split(text, ' '), 1, {S.WINDOW_TOKENS}), ' ')
      AS text
    FROM (SELECT subject_id, {lists()} AS text FROM kept_tok GROUP BY subject_id)"""
CTES["fixed"] = f"""
    SELECT * FROM (VALUES {values((f"'{t}'", i) for i, t in enumerate(FIXED))}) v(token, token_id)"""
CTES["vocab"] = f"""
    SELECT token, token_id::bigint AS token_id FROM fixed
    UNION ALL SELECT code, {len(FIXED)} + row_number() OVER (ORDER BY code) - 1
      FROM (SELECT DISTINCT code FROM kept WHERE code <> '')
    UNION ALL SELECT s, {len(FIXED)} + (SELECT count(DISTINCT code) FROM kept WHERE code <> '') + i
      FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2), ('<pad>', 3)) x(s, i)"""
for special, name in [("<unk>", "unk"), ("<s>", "bos"), ("</s>", "eos"), ("<pad>", "pad")]:
    CTES[f"id_{name}"] = f"SELECT token_id AS id FROM vocab WHERE token = '{special}'"
CTES["words"] = r"""
    SELECT subject_id, unnest(list) AS token, generate_subscripts(list, 1) - 1 AS pos
    FROM (SELECT subject_id, regexp_extract_all(text, '\w+|[^\w\s]+') AS list FROM seqs)"""
CTES["ids"] = """
    SELECT subject_id, pos, coalesce(v.token_id, (SELECT id FROM id_unk)) AS id
    FROM words LEFT JOIN vocab v USING (token)"""
CTES["enc"] = """
    SELECT subject_id, list(id ORDER BY pos) AS ids, count(*) AS n FROM ids GROUP BY subject_id"""
CTES["daycuts"] = f"""
    SELECT * FROM (VALUES {values((f"'{t}'", d) for t, d in S.GAP_DAYS.items())}) v(token, days)"""
# Exploded tokens of birth rows: position, days of the token, days up to and with it.
CTES["birth_rows"] = """
    SELECT subject_id, string_split(text, ' ') AS tokens, len(string_split(text, ' ')) AS n
    FROM seqs WHERE list_contains(string_split(text, ' '), 'MEDSzzBIRTH')"""
CTES["bt0"] = """
    SELECT subject_id, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos
    FROM birth_rows"""
CTES["bt"] = """
    SELECT subject_id, n, token, pos, coalesce(days, 0) AS days,
      sum(coalesce(days, 0)) OVER (PARTITION BY subject_id ORDER BY pos) AS upto
    FROM bt0 LEFT JOIN daycuts USING (token)"""
CTES["births"] = """
    SELECT subject_id, min(pos) AS birth FROM bt WHERE token = 'MEDSzzBIRTH' GROUP BY subject_id"""
CTES["cand"] = """
    SELECT subject_id, any_value(n) AS len, any_value(birth) AS birth_token,
      coalesce(sum(days) FILTER (pos >= birth + 2), 0) / 365 AS time_ehr
    FROM bt JOIN births USING (subject_id) GROUP BY subject_id"""


def task_stops(name: str, targets: str, seed: int, task: str = "") -> dict[str, str]:
    """First target and every stopping rule; ``targets`` is a relation (token[, task])."""
    keys = f"subject_id{', task' if task else ''}"
    per_task = "CROSS JOIN (SELECT DISTINCT task FROM tasks) t" if task else ""
    match = "g.token = bt.token AND g.task = f.task" if task else "g.token = bt.token"
    rows = f"{name}_rows"
    return {
        rows: f"SELECT * FROM cand {per_task}",
        f"{name}_first": f"""
    SELECT {', '.join('f.' + k for k in keys.split(', '))}, any_value(f.len) AS len,
      coalesce(min(bt.pos) FILTER (g.token IS NOT NULL), -1) AS first_target
    FROM {rows} f JOIN bt USING (subject_id) LEFT JOIN {targets} g ON {match}
    GROUP BY ALL""",
        f"{name}_ends": f"""
    SELECT {keys}, pos, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS i,
      count(*) OVER (PARTITION BY {keys}) AS m
    FROM {name}_first f JOIN (SELECT subject_id, pos FROM bt WHERE token = 'VIEnd') e
      USING (subject_id)
    WHERE pos < CASE WHEN first_target >= 0 THEN first_target ELSE len - 1 END""",
        f"{name}_stop": f"""
    SELECT {keys}, len, first_target, coalesce(pos + 1, -1) AS end_visit
    FROM {name}_first LEFT JOIN (
      SELECT {keys}, pos FROM {name}_ends
      WHERE m > 1 AND i = {hash32(f'{seed}|end_visit', 'subject_id')} % (m - 1)) USING ({keys})""",
    }


def label_from(relation: str, start: str, hit: str, horizon: int, keys: str = "subject_id",
               join: str = "") -> str:
    """Horizon label by cumulative days: any hit at ``pos >= start`` within the horizon."""
    return f"""
    SELECT {keys}, max(CASE WHEN NOT starts_with(token, 'TIME_') AND {hit}
        AND upto - base <= {horizon} THEN 1 ELSE 0 END) AS label
    FROM (
      SELECT r.*, bt.token, bt.upto, bt.pos, min(bt.upto - bt.days) OVER (PARTITION BY {keys}) AS base
      FROM {relation} r JOIN bt USING (subject_id) WHERE bt.pos >= r.{start}) z {join}
    GROUP BY {keys}"""


TASK_HIT = targets_hit("token", R.TARGETS)
CTES["goals"] = f"SELECT unnest([{', '.join(repr(t) for t in R.TARGETS)}]) AS token"
CTES["tasks"] = """
    SELECT DISTINCT 'TASK' || (50000 + p_partkey % 40) % 10 AS task,
      'CDzz' || (50000 + p_partkey % 40) AS token FROM part"""
CTES |= task_stops("one", "goals", R.TASK.seed)
CTES |= task_stops("many", "tasks", 0, task="task")
CTES["one_valid"] = "SELECT * FROM one_stop WHERE end_visit > 0 AND end_visit < len"
CTES["one_label"] = label_from("one_valid", "end_visit", TASK_HIT, R.TASK.horizon_days)
CTES["many_valid"] = "SELECT * FROM many_stop WHERE end_visit > 0 AND end_visit < len AND end_visit < 2048 - 128"
CTES["many_label"] = """
    SELECT subject_id, task, max(CASE WHEN upto - base <= 730 AND EXISTS (
        SELECT 1 FROM tasks g WHERE g.task = z.task AND contains(z.token, g.token)) THEN 1 ELSE 0 END)
      AS label
    FROM (
      SELECT r.subject_id, r.task, bt.token, bt.upto,
        min(bt.upto - bt.days) OVER (PARTITION BY r.subject_id, r.task) AS base
      FROM many_valid r JOIN bt USING (subject_id) WHERE bt.pos >= r.end_visit) z
    GROUP BY subject_id, task"""
CTES["middle"] = "SELECT subject_id, len // 2 AS mid FROM cand"
CTES["mid_label"] = label_from("middle", "mid", TASK_HIT, 730)
# Visit spans by a running count of marks: openings are those behind an end mark.
CTES["marks"] = """
    SELECT subject_id, pos, token = 'VIEnd' AS closes,
      lag(token = 'VIEnd') OVER (PARTITION BY subject_id ORDER BY pos) AS after_end
    FROM st WHERE starts_with(token, 'VI')"""
CTES["st"] = """
    SELECT subject_id, unnest(string_split(text, ' ')) AS token,
      generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM seqs"""
CTES["sizes"] = "SELECT subject_id, count(*) AS n FROM st GROUP BY subject_id"
CTES["spans"] = """
    SELECT o.subject_id, o.pos AS first_pos, coalesce(
        (SELECT min(e.pos) FROM marks e
         WHERE e.subject_id = o.subject_id AND e.closes AND e.pos > o.pos), s.n - 1) AS last_pos,
      row_number() OVER (PARTITION BY o.subject_id ORDER BY o.pos) - 1 AS i
    FROM marks o JOIN sizes s USING (subject_id)
    WHERE NOT o.closes AND (o.after_end IS NULL OR o.after_end)"""
CTES["drawn"] = f"""
    SELECT subject_id, copy, first_pos, last_pos, n, extra,
      n - coalesce(sum(last_pos - first_pos + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS left_before
    FROM (
      SELECT s.*, z.n, c.copy, {md5_of('11|visit', 'subject_id', 'copy', 'i')} AS d,
        {hash32('11|extra', 'subject_id', 'copy')} % {R.DROPS.max_extra_visits + 2} AS extra
      FROM spans s JOIN sizes z USING (subject_id), (SELECT unnest(range({R.DROPS.copies})) AS copy) c)
    WINDOW w AS (PARTITION BY subject_id, copy ORDER BY d)"""
CTES["gone"] = f"""
    SELECT subject_id, copy, first_pos, last_pos FROM (
      SELECT *, coalesce(sum(CASE WHEN left_before <= {R.DROPS.target_tokens} THEN 1 ELSE 0 END)
          OVER (PARTITION BY subject_id, copy ORDER BY left_before DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fits
      FROM drawn)
    WHERE left_before > {R.DROPS.target_tokens} OR fits < extra"""
CTES["copies"] = f"""
    SELECT t.subject_id, t.copy, string_agg(t.token, ' ' ORDER BY t.pos) AS text
    FROM (SELECT * FROM st, (SELECT unnest(range({R.DROPS.copies})) AS copy) c) t
    LEFT JOIN gone g ON g.subject_id = t.subject_id AND g.copy = t.copy
      AND t.pos BETWEEN g.first_pos AND g.last_pos
    WHERE g.subject_id IS NULL GROUP BY t.subject_id, t.copy"""
CTES["rows_split"] = ranked_split("seqs", S.ROW_SPLIT_SEED, "(1 - 0.1::double)")
CTES["subjects_split"] = ranked_split(
    "(SELECT DISTINCT person_id AS subject_id FROM person)", S.SPLIT_SEED, "(1 - 0.2::double)"
)
CTES["prs"] = """
    SELECT vec_id AS subject_id, list_transform(embedding, lambda x:
      CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE x::double END) AS prs FROM embeddings"""
CTES["presence"] = """
    SELECT subject_id, len(list_filter(prs, lambda x: x <> 0)) > 0 AS has_prs FROM prs"""
CTES["steps"] = f"""
    SELECT event_id // 128 AS subject_id, event_id // 32 % 4 AS seq, event_id % 32 AS step,
      ['TIME_M_6', 'CDzz50003', 'TIME_Y_1', 'VIEnd', 'CDzz50012'][{KIND} + 1] AS token,
      value / 1000 AS p FROM events"""
CTES["step_days"] = """
    SELECT s.*, coalesce(days, 0) AS days, coalesce(sum(coalesce(days, 0)) OVER (
        PARTITION BY subject_id, seq ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM steps s LEFT JOIN daycuts USING (token)"""
CTES["hits"] = """
    SELECT subject_id, seq, 1 - product(1 - p) FILTER (earlier <= 1000) AS score,
      1 - product(1 - p) AS unbound FROM step_days GROUP BY subject_id, seq"""
CTES["generated"] = f"""
    SELECT subject_id, seq, string_agg(token, ' ' ORDER BY step) AS generated_text,
      max(CASE WHEN {targets_hit('token', R.TARGETS)} AND earlier + days <= 1000 THEN 1 ELSE 0 END)
        AS pred_label
    FROM step_days GROUP BY subject_id, seq"""
CTES["logit_steps"] = f"""
    SELECT event_id // 128 AS subject_id, event_id // 32 % 4 AS seq, event_id % 32 AS step,
      (event_id * 7919 + user_id) % (SELECT count(*) FROM vocab) AS token_id,
      list_transform(range((SELECT count(*) FROM vocab)),
        lambda i: (cast(round(value * 100) AS bigint) * (i + 3)) % 997 / 100.0::double) AS logits,
      (SELECT list(token_id) FROM vocab WHERE token IN {in_list(R.TARGETS)}) AS goal_ids
    FROM events"""
CTES["named_steps"] = """
    SELECT subject_id, seq, step, token, coalesce(days, 0) AS days,
      CASE WHEN token NOT IN ('<unk>', '<s>', '</s>', '<pad>') THEN token END AS shown,
      coalesce(list_sum(list_transform(goal_ids, lambda g: exp(logits[g + 1]))), 0)
        / list_sum(list_transform(logits, lambda x: exp(x))) AS p
    FROM logit_steps JOIN vocab USING (token_id) LEFT JOIN daycuts USING (token)"""
CTES["logit_days"] = """
    SELECT *, coalesce(sum(days) OVER (PARTITION BY subject_id, seq ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM named_steps"""
CTES["logit_scores"] = f"""
    SELECT subject_id, seq, string_agg(shown, ' ' ORDER BY step) AS generated_text,
      max(CASE WHEN {targets_hit('shown', R.TARGETS)} AND earlier <= {R.TASK.horizon_days}
        THEN 1 ELSE 0 END) AS pred_label,
      1 - product(1 - p) FILTER (earlier <= {R.TASK.horizon_days}) AS score
    FROM logit_days GROUP BY subject_id, seq"""
CTES["one_ev"] = f"""
    SELECT * FROM ev WHERE subject_id = {R.SUBJECT} AND (time IS NULL OR time < {R.CUTOFF})"""
CTES["one_ev_tok"] = tokenised("one_ev", "kept")
CTES["one_all"] = f"SELECT * FROM ev WHERE subject_id = {R.SUBJECT}"
CTES["one_all_tok"] = tokenised("one_all", "kept")
CTES["one_words"] = f"""
    SELECT subject_id, n_events, len(list) AS n_tokens, list[-{R.SUBJECT_WINDOW}:] AS list
    FROM (SELECT subject_id, count(*) AS n_events,
        string_split(string_agg(event_text, ' ' ORDER BY pos), ' ') AS list
      FROM one_ev_tok GROUP BY subject_id)"""
CTES["one_ids"] = r"""
    SELECT pos, coalesce(v.token_id, (SELECT id FROM id_unk)) AS id
    FROM (SELECT unnest(list) AS token, generate_subscripts(list, 1) AS pos
      FROM (SELECT regexp_extract_all(array_to_string(list, ' '), '\w+|[^\w\s]+') AS list FROM one_words))
    LEFT JOIN vocab v USING (token)"""
CTES["losses"] = """
    SELECT event_id // 32 AS subject_id, event_id // 128 AS batch_id,
      CASE WHEN event_id % 7 = 0 THEN -100 ELSE user_id END AS label, value / 100 AS loss
    FROM events"""
CTES["preds"] = """
    SELECT l.subject_id, array_to_string(list_slice(tokens, 1, end_visit), ' ') AS original_text,
      l.label AS label_token, g.*
    FROM one_label l JOIN one_valid v USING (subject_id) JOIN birth_rows b USING (subject_id)
    LEFT JOIN (
      SELECT subject_id AS sid, string_agg(generated_text, '|' ORDER BY seq) AS texts,
        string_agg(pred_label::varchar, ' ' ORDER BY seq) AS labels, avg(pred_label) AS probability,
        list(score ORDER BY seq) AS scores
      FROM generated JOIN hits USING (subject_id, seq) GROUP BY subject_id) g ON g.sid = l.subject_id"""
CTES["scored_docs"] = """
    SELECT doc_id, quality, lang, round((n_chars % 997) / 997, 2) AS score
    FROM labels JOIN documents USING (doc_id)"""
CTES["subject_preds"] = "SELECT c.subject_id, m.label AS label, [{}] AS scores FROM cand c JOIN mid_label m USING (subject_id)".format(
    ", ".join(f"({hash32(f'score|{i}', 'c.subject_id')} % 101) / 100" for i in range(4))
)
CTES["ages"] = "SELECT subject_id, max(upto) / 365 AS age FROM bt GROUP BY subject_id"
CTES["buckets"] = "SELECT subject_id, age, {} AS age_bucket FROM ages".format(
    case(
        [(f"age < {below}", f"'{label}'") for below, label in S.AGE_BUCKETS if below],
        f"'{S.AGE_BUCKETS[-1][1]}'",
    )
)
CTES["dict"] = """
    SELECT DISTINCT 'CDzz' || concept_id AS code, 'Concept ' || concept_id AS concept_name FROM conditions
    UNION ALL SELECT DISTINCT 'PRzz' || concept_id, 'Concept ' || concept_id FROM procedures
    UNION ALL SELECT DISTINCT 'MSzz' || concept_id, 'Concept ' || concept_id FROM measurements
    UNION ALL SELECT DISTINCT 'DRzz' || concept_id, 'Concept ' || concept_id FROM drugs
    UNION ALL SELECT DISTINCT 'VSzz' || concept_id, name FROM visits
    UNION ALL SELECT DISTINCT 'GENzz' || gender, NULL FROM person
    UNION ALL SELECT DISTINCT 'SEXzz' || sex, NULL FROM person
    UNION ALL SELECT 'RACzz' || race, n_name FROM (SELECT DISTINCT race FROM person)
      LEFT JOIN nation ON race = 8700 + n_nationkey
    UNION ALL SELECT 'MEDSzzBIRTH', 'Birth date'"""


def auc_sql(relation: str, groups: str = "", label: str = "label", score: str = "score") -> str:
    """AUC by the Mann-Whitney rank sum with average ranks; ``w`` weighs rows."""
    by = f"PARTITION BY {groups}" if groups else ""
    select = f"{groups}, " if groups else ""
    return f"""
    SELECT {select} sum(pos) AS n_pos, sum(neg) AS n_neg,
      sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)::double) AS auc
    FROM (
      SELECT *, sum(neg) OVER ({by} ORDER BY score) - neg AS below FROM (
        SELECT {select} {score} AS score, sum(w) FILTER ({label} = 1) AS p, sum(w) FILTER ({label} = 0) AS q,
          coalesce(p, 0) AS pos, coalesce(q, 0) AS neg
        FROM {relation} GROUP BY ALL))
    GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0"""


def report_sql(relation: str, key: str, groups: str = "", label: str = "label") -> str:
    """Report with replicates 0, 1, … until the wanted number is valid, at most fourfold."""
    h = hash32(5, "b", key)
    w = case([(f"h < {c}", str(k)) for k, c in enumerate(poisson_cuts())], str(len(poisson_cuts())))
    sel = f"{groups}, " if groups else ""
    by = f"PARTITION BY {groups}" if groups else ""
    join = f"USING ({groups})" if groups else "ON true"
    return f"""
    WITH point AS ({auc_sql(f'(SELECT *, 1 AS w FROM {relation})', groups, label)}),
    boot AS ({auc_sql(f'''(SELECT *, {w} AS w FROM (
        SELECT *, {h} AS h FROM {relation}, (SELECT unnest(range({R.ITERATIONS * 4})) AS b)))''',
        sel + 'b', label)}),
    first AS (
      SELECT *, row_number() OVER ({by} ORDER BY b) AS r FROM boot
      QUALIFY r <= {R.ITERATIONS}),
    ci AS (
      SELECT {sel} count(*) AS n_valid, quantile_cont(auc, {(1.0 - 0.95) / 2.0}) AS lo,
        quantile_cont(auc, {1.0 - (1.0 - 0.95) / 2.0}) AS hi
      FROM first GROUP BY ALL)
    SELECT {sel} cast(n_pos + n_neg AS bigint) AS n, round(auc, 9) AS auc, round(lo, 9) AS ci_low,
      round(hi, 9) AS ci_high, n_valid
    FROM point JOIN ci {join}"""


def ids_text(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


CTES["pad_rows"] = f"""
    SELECT subject_id, list_append(ids, (SELECT id FROM id_eos)) AS ids, n + 1 AS n FROM enc"""
CTES["numbered"] = "SELECT *, row_number() OVER (ORDER BY subject_id) - 1 AS row_id FROM enc"
CTES["cut_rows"] = f"""
    SELECT row_id, row_id // {R.BATCH} AS batch_id, list_slice(ids, 1, {R.TAIL}) AS ids FROM numbered"""
CTES["cut_batches"] = """
    SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS missing FROM cut_rows"""
CTES["full_batches"] = f"""
    SELECT *, row_id // {R.BATCH} AS batch_id,
      max(len(ids)) OVER (PARTITION BY row_id // {R.BATCH}) - len(ids) AS missing FROM numbered"""


def fill(value: str, n: str) -> str:
    return f"list_transform(range({n}), lambda i: {value})"


SEQ_HEAD = f"""
    SELECT subject_id, array_to_string(list_slice(string_split(text, ' '), 1, {R.HEAD}), ' ') AS text
    FROM (SELECT subject_id, {lists()} AS text FROM tok GROUP BY subject_id)"""
EVENT_SELECT = "SELECT subject_id, time, code, numeric_value, visit_id, visit_type"

FINAL: dict[str, str] = {
    **{f"{b}_events": f"{EVENT_SELECT} FROM ev_{b}" for b in BRANCHES},
    "all_events": f"{EVENT_SELECT} FROM ev",
    "sampled_events": f"{EVENT_SELECT} FROM ev_sample",
    "source_row_counts": """
    WITH c AS (
      SELECT 'condition' AS source, count(*) AS n_row FROM conditions
      UNION ALL SELECT 'procedure', count(*) FROM procedures
      UNION ALL SELECT 'measurement', count(*) FROM measurements
      UNION ALL SELECT 'drug', count(*) FROM drugs UNION ALL SELECT 'visit', count(*) FROM visits
      UNION ALL SELECT 'demographics', count(*) * 3 FROM person)
    SELECT source, n_row FROM c UNION ALL SELECT 'total', cast(sum(n_row) AS bigint) FROM c""",
    "distinct_subjects": "SELECT DISTINCT person_id AS subject_id FROM person",
    "subject_split": "SELECT subject_id, split FROM subjects_split",
    "split_events": f"{EVENT_SELECT}, split FROM ev JOIN subjects_split USING (subject_id)",
    "split_sampled_events": f"""
    WITH sp AS ({ranked_split('(SELECT DISTINCT subject_id FROM ev_sample)', S.SPLIT_SEED, '(1 - 0.2::double)')})
    {EVENT_SELECT}, split FROM ev_sample JOIN sp USING (subject_id)""",
    "single_subject_events": f"{EVENT_SELECT} FROM ev WHERE subject_id = {R.SUBJECT}",
    "events_before_cutoff": f"""
    {EVENT_SELECT}, strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date
    FROM ev WHERE time IS NULL OR time < {R.CUTOFF}""",
    "cutoff_counts": f"""
    SELECT count(*) AS n_before, count(*) FILTER (time IS NULL OR time < {R.CUTOFF}) AS n_after,
      count(*) FILTER (time >= {R.CUTOFF}) AS n_removed FROM ev""",
    "data_dictionary": "SELECT code, concept_name FROM dict",
    "token_names": "SELECT token, {} AS category, {} AS visit_label, {} AS concept_name FROM (SELECT DISTINCT token FROM st) LEFT JOIN (SELECT code AS token, max(concept_name) AS concept_name FROM dict GROUP BY code) USING (token)".format(
        case((f"starts_with(token, '{p}')", f"'{n}'") for p, n in S.CODE_CATEGORIES.items()),
        case((f"token = '{g}'", f"'{n}'") for g, n in S.VISIT_LABELS.items()),
        "CASE WHEN "
        + " OR ".join(f"starts_with(token, '{p}')" for p in S.CODE_CATEGORIES)
        + " THEN coalesce(concept_name, '(not in dictionary)') END",
    ),
    "rare_code_filter": f"""
    {EVENT_SELECT} FROM ev WHERE code IN (
      SELECT code FROM ev GROUP BY code HAVING count(DISTINCT subject_id) >= 100)""",
    "subject_activity_filter": f"""
    {EVENT_SELECT} FROM ev WHERE subject_id IN (
      SELECT subject_id FROM ev GROUP BY subject_id HAVING count(code) BETWEEN 40 AND 62)""",
    "two_round_filter": f"{EVENT_SELECT} FROM two",
    "code_deciles": """
    SELECT code, k AS decile, round(quantile_cont(numeric_value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])[k], 9)
      AS value
    FROM ev, (SELECT unnest(range(1, 10)) AS k) WHERE numeric_value IS NOT NULL GROUP BY code, k""",
    "tokenised_events": """
    SELECT subject_id, pos, cast(time * 1e6 AS bigint) AS timestamp,
      strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS datetime, code,
      time_token, quantile_token, visit_token, visit_end_token, event_text FROM tok""",
    "open_gap_tokens": "SELECT subject_id, pos, gap AS day_gap, {} AS open_token FROM tok".format(
        case(
            [(f"gap >= {s}", f"'TIME_{u}_' || gap // {s}") for u, s, _ in reversed(S.GAP_UNITS)],
            "'DUMMY'",
        )
    ),
    "sequence_parts": f"""
    SELECT subject_id, cast((pos - 1) // 50 AS integer) AS part, {lists()} AS text
    FROM tok GROUP BY ALL""",
    "sequence_heads": SEQ_HEAD,
    "curated_sequences": "SELECT subject_id, text FROM seqs",
    "vocabulary": "SELECT token, token_id FROM vocab",
    "encoded_sequences": f"""
    SELECT subject_id, text, {ids_text('ids')} AS input_ids, n AS n_mask FROM enc JOIN seqs USING (subject_id)""",
    "padded_sequences": f"""
    SELECT subject_id,
      {ids_text(f"list_concat({fill('pad', f'greatest({R.PAD_TO} - n, 0)')}, list_slice(ids, 1, {R.PAD_TO}))")}
        AS input_ids,
      {ids_text(f"list_concat({fill('0', f'greatest({R.PAD_TO} - n, 0)')}, {fill('1', f'least(n, {R.PAD_TO})')})")}
        AS attention_mask
    FROM (SELECT *, (SELECT id FROM id_pad) AS pad FROM pad_rows)""",
    "decoded_sequences": """
    SELECT subject_id, string_agg(token, ' ' ORDER BY pos) FILTER (token IS NOT NULL) AS text
    FROM (
      SELECT subject_id, pos, CASE WHEN token NOT IN ('<unk>', '<s>', '</s>', '<pad>') THEN token END AS token
      FROM ids JOIN vocab ON id = token_id) GROUP BY subject_id""",
    "unknown_tokens": r"""
    SELECT subject_id, token, count(*) AS n FROM (
      SELECT subject_id, unnest(regexp_extract_all(event_text, '\w+|[^\w\s]+')) AS token FROM tok)
    WHERE token NOT IN (SELECT token FROM fixed) AND token NOT IN ('<s>', '</s>', '<pad>')
      AND token NOT IN (SELECT code FROM ev GROUP BY code HAVING count(DISTINCT subject_id) >= 100)
    GROUP BY subject_id, token""",
    "last_tokens": f"SELECT subject_id, {ids_text(f'list_slice(ids, greatest(n - {R.TAIL} + 1, 1), n)')} AS input_ids FROM enc",
    "training_examples": f"""
    SELECT row_number() OVER (ORDER BY {md5_of(7, 'subject_id')}) - 1 AS row_id,
      {ids_text(f'list_slice(ids, 1, {R.HEAD})')} AS input_ids FROM enc""",
    "shifted_batches": f"""
    SELECT batch_id, row_id, {ids_text(f"list_concat(ids, {fill('pad', 'missing')})")} AS input_ids,
      {ids_text(f"list_concat(list_slice(ids, 2, len(ids)), {fill('-100', 'missing + 1')})")} AS labels
    FROM (SELECT *, (SELECT id FROM id_pad) AS pad FROM cut_batches)""",
    "causal_batches": f"""
    SELECT batch_id, row_id, subject_id,
      {ids_text(f"list_concat({fill('pad', 'missing')}, ids)")} AS input_ids,
      {ids_text(f"list_concat({fill('0', 'missing')}, {fill('1', 'len(ids)')})")} AS attention_mask,
      {ids_text(f"list_concat({fill('-100', 'missing')}, ids)")} AS labels
    FROM (SELECT *, (SELECT id FROM id_pad) AS pad FROM full_batches)""",
    "row_split": "SELECT subject_id, split FROM rows_split",
    "visit_spans": "SELECT subject_id, cast(first_pos AS integer) AS first_pos, cast(last_pos AS integer) AS last_pos FROM spans",
    "visit_dropped_copies": "SELECT subject_id, cast(copy AS integer) AS copy, text FROM copies",
    "zero_prs_copies": """
    SELECT subject_id, z AS zeroed, array_to_string(list_transform(prs, lambda x:
        cast(round(CASE WHEN z = 1 THEN 0 ELSE x END * 1e9) AS bigint)), ' ') AS prs
    FROM prs JOIN presence USING (subject_id), (SELECT unnest([0, 1])::bigint AS z) WHERE z = 0 OR has_prs""",
    "encoded_texts": f"SELECT subject_id, {ids_text('ids')} AS input_ids FROM enc",
    "augmented_dataset": r"""
    WITH r AS (
      SELECT subject_id, split, copy, c.text FROM copies c JOIN rows_split USING (subject_id) WHERE split = 'train'
      UNION ALL SELECT subject_id, split, 0, text FROM seqs JOIN rows_split USING (subject_id) WHERE split = 'test'),
    w AS (
      SELECT subject_id, copy, unnest(list) AS token, generate_subscripts(list, 1) AS pos
      FROM (SELECT *, regexp_extract_all(text, '\w+|[^\w\s]+') AS list FROM r))
    SELECT r.subject_id, split, cast(r.copy AS integer) AS copy, text, input_ids
    FROM r JOIN (
      SELECT subject_id, copy, string_agg(coalesce(token_id, (SELECT id FROM id_unk))::varchar, ' ' ORDER BY pos)
        AS input_ids
      FROM w LEFT JOIN vocab USING (token) GROUP BY ALL) USING (subject_id, copy)""",
    "augmented_prs_dataset": r"""
    WITH r AS (
      SELECT subject_id, split, copy, c.text FROM copies c JOIN rows_split USING (subject_id) WHERE split = 'train'
      UNION ALL SELECT subject_id, split, 0, text FROM seqs JOIN rows_split USING (subject_id) WHERE split = 'test'),
    w AS (
      SELECT subject_id, copy, unnest(list) AS token, generate_subscripts(list, 1) AS pos
      FROM (SELECT *, regexp_extract_all(text, '\w+|[^\w\s]+') AS list FROM r))
    SELECT r.subject_id, split, cast(r.copy AS integer) AS copy, z AS zeroed, text, input_ids,
      array_to_string(list_transform(prs, lambda x:
        cast(round(CASE WHEN z = 1 THEN 0 ELSE x END * 1e9) AS bigint)), ' ') AS prs
    FROM r JOIN (
      SELECT subject_id, copy, string_agg(coalesce(token_id, (SELECT id FROM id_unk))::varchar, ' ' ORDER BY pos)
        AS input_ids
      FROM w LEFT JOIN vocab USING (token) GROUP BY ALL) USING (subject_id, copy)
    LEFT JOIN prs USING (subject_id) LEFT JOIN presence USING (subject_id), (SELECT unnest([0, 1])::bigint AS z)
    WHERE z = 0 OR (has_prs AND split = 'train')""",
    "scaled_prs": """
    SELECT subject_id, array_to_string(list_transform(prs, lambda x:
        cast(round(greatest(least(x, 0.1::double), -0.1::double) / 0.1::double * 1e9) AS bigint)), ' ') AS features,
      has_prs FROM prs JOIN presence USING (subject_id)""",
    "prs_presence": "SELECT subject_id, has_prs FROM presence",
    "cohort_candidates": """
    SELECT subject_id, cast(len AS integer) AS len, cast(birth_token AS integer) AS birth_token,
      round(time_ehr, 9) AS time_ehr FROM cand WHERE time_ehr > 5""",
    "cumulative_ages": "SELECT subject_id, cast(pos AS integer) AS pos, token, round(upto / 365, 9) AS age_years FROM bt",
    "token_years_after": """
    SELECT subject_id, cast(coalesce(min(pos) FILTER (pos > birth AND upto >= base + 3 * 365), -1) AS integer)
      AS n_year_token
    FROM bt JOIN (
      SELECT subject_id, birth, any_value(upto) FILTER (pos = birth + 1) AS base
      FROM bt JOIN births USING (subject_id) GROUP BY ALL) USING (subject_id)
    GROUP BY subject_id""",
    "first_targets": "SELECT subject_id, cast(first_target AS integer) AS first_target FROM one_first",
    "stopping_points": f"""
    SELECT subject_id, cast(CASE WHEN first_target >= 0 THEN first_target + 1 ELSE -1 END AS integer) AS first_target,
      cast(len // 4 + {hash32('0|random', 'subject_id')} % (len // 4 * 2 + 1) AS integer) AS random,
      cast(coalesce(t + 1, -1) AS integer) AS demo_age, cast(end_visit AS integer) AS end_visit
    FROM one_stop LEFT JOIN (
      SELECT subject_id, min(pos) AS t FROM bt WHERE contains(token, 'TIME') GROUP BY subject_id)
      USING (subject_id)""",
    "horizon_labels": f"""
    SELECT subject_id, a.label AS label_365, b.label AS label_730, c.label AS label_exact
    FROM ({label_from('middle', 'mid', TASK_HIT, 365)}) a
    JOIN ({label_from('middle', 'mid', TASK_HIT, 730)}) b USING (subject_id)
    JOIN ({label_from('middle', 'mid', f'token IN {in_list(R.TARGETS)}', 730)}) c USING (subject_id)""",
    "evaluation_set": f"""
    SELECT subject_id, cast(v.len AS integer) AS len, cast(birth_token AS integer) AS birth_token,
      round(time_ehr, 9) AS time_ehr, cast(first_target AS integer) AS first_target,
      cast(end_visit AS integer) AS stopping_time, label AS label_token,
      {ids_text('list_slice(ids, 1, end_visit)')} AS input_ids, cast(end_visit AS integer) AS n_mask
    FROM one_valid v JOIN one_label USING (subject_id) JOIN cand USING (subject_id)
    JOIN enc USING (subject_id) WHERE end_visit < 250 - 128""",
    "followup_evaluation_set": f"""
    WITH f AS (
      SELECT subject_id, first_target, first_target + 1 AS stop FROM one_first
      WHERE first_target >= 0 AND first_target + 1 < len AND first_target + 1 < 2048 - 128)
    SELECT subject_id, cast(first_target AS integer) AS first_target, cast(stop AS integer) AS stopping_time,
      label AS label_token
    FROM f JOIN ({label_from('f', 'stop', targets_hit('token', R.FOLLOWUP.followup_targets), 730)}) USING (subject_id)""",
    "task_evaluation_sets": """
    SELECT subject_id, task, cast(first_target AS integer) AS first_target,
      cast(end_visit AS integer) AS stopping_time, label AS label_token
    FROM many_valid JOIN many_label USING (subject_id, task)""",
    "seeded_sample": f"SELECT subject_id FROM seqs ORDER BY {md5_of(42, 'subject_id')} LIMIT {R.SAMPLE}",
    "target_mass": "SELECT vec_id, round(({}) / list_sum(list_transform(embedding, lambda x: exp(x::double))), 9) AS mass FROM embeddings".format(
        " + ".join(f"exp(embedding[{i + 1}]::double)" for i in R.LOGIT_TARGETS)
    ),
    "first_hit_probability": "SELECT subject_id, seq, round(score, 9) AS score, round(unbound, 9) AS unbound FROM hits",
    "generated_labels": "SELECT subject_id, seq, generated_text, pred_label FROM generated",
    "prediction_rows": """
    SELECT subject_id, original_text, label_token, coalesce(texts, '') AS generated_text,
      coalesce(labels, '') AS pred_labels, round(probability, 9) AS probability,
      coalesce(array_to_string(list_transform(scores, lambda x: cast(round(x * 1e9) AS bigint)), ' '), '')
        AS probability_scores,
      4 AS num_predictions, 32 AS max_new_tokens, 'steps' AS model_name FROM preds""",
    "single_subject_sequence": f"""
    SELECT subject_id, n_events, n_tokens::bigint AS n_tokens, array_to_string(list, ' ') AS text,
      (SELECT string_agg(id::varchar, ' ' ORDER BY pos) FROM (
        SELECT * FROM one_ids ORDER BY pos DESC LIMIT {R.SUBJECT_WINDOW})) AS input_ids,
      (SELECT string_agg('1', ' ') FROM (SELECT * FROM one_ids LIMIT {R.SUBJECT_WINDOW})) AS attention_mask
    FROM one_words""",
    "single_subject_unknown": r"""
    SELECT token, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all(event_text, '\w+|[^\w\s]+')) AS token FROM one_all_tok)
    WHERE token NOT IN (SELECT token FROM vocab WHERE token <> '<unk>') GROUP BY token""",
    "scored_predictions": """
    SELECT l.subject_id, l.label AS label_token,
      length(array_to_string(list_slice(tokens, 1, end_visit), ' '))::int AS n_original,
      coalesce(texts, '') AS generated_text, coalesce(labels, '') AS pred_labels,
      round(probability, 9) AS probability, coalesce(scores, '') AS probability_scores
    FROM one_label l JOIN one_valid v USING (subject_id) JOIN birth_rows b USING (subject_id)
    LEFT JOIN (
      SELECT subject_id AS sid, string_agg(generated_text, '|' ORDER BY seq) AS texts,
        string_agg(pred_label::varchar, ' ' ORDER BY seq) AS labels, avg(pred_label) AS probability,
        string_agg(cast(round(score * 1e9) AS bigint)::varchar, ' ' ORDER BY seq) AS scores
      FROM logit_scores GROUP BY subject_id) g ON g.sid = l.subject_id""",
    "validation_loss": "SELECT round(avg(loss), 9) AS avg_loss, NULL::varchar AS message FROM losses WHERE label <> -100",
    "example_losses": """
    SELECT subject_id, round(coalesce(sum(loss) FILTER (label <> -100), 0) / greatest(count(*) FILTER (label <> -100), 1), 9)
      AS test_loss FROM losses GROUP BY subject_id""",
    "overall_loss": """
    SELECT round(avg(m), 9) AS test_loss, count(*) AS n_batches FROM (
      SELECT avg(loss) FILTER (label <> -100) AS m FROM losses GROUP BY batch_id)""",
    "probability_aggregates": """
    SELECT subject_id, round(list_avg(scores), 9) AS mean, round(list_max(scores), 9) AS max,
      round(list_median(scores), 9) AS median FROM subject_preds""",
    "age_buckets": "SELECT subject_id, round(age, 9) AS age, age_bucket FROM buckets",
    "overall_auc": f"""
    SELECT cast(n_pos AS bigint) AS n_pos, cast(n_neg AS bigint) AS n_neg, round(auc, 9) AS auc
    FROM ({auc_sql('(SELECT *, 1 AS w FROM scored_docs)', '', 'quality')})""",
    "auc_by_language": f"""
    SELECT lang, cast(n_pos AS bigint) AS n_pos, cast(n_neg AS bigint) AS n_neg, round(auc, 9) AS auc
    FROM ({auc_sql('(SELECT *, 1 AS w FROM scored_docs)', 'lang', 'quality')})""",
    "overall_report": report_sql("scored_docs", "doc_id", "", "quality"),
    "report_by_age": report_sql(
        "(SELECT subject_id, label, list_avg(scores) AS score, age_bucket FROM subject_preds JOIN buckets USING (subject_id))",
        "subject_id",
        "age_bucket",
    ),
    "report_by_prs": report_sql(
        "(SELECT subject_id, label, list_max(scores) AS score, coalesce(has_prs, false) AS has_prs "
        "FROM subject_preds LEFT JOIN presence USING (subject_id))",
        "subject_id",
        "has_prs",
    ),
    "csv_row_counts": "SELECT split, count(*) AS n_rows FROM ev JOIN subjects_split USING (subject_id) GROUP BY split",
    "sequence_text_round_trip": "SELECT text FROM seqs",
    "dataset_round_trip": "SELECT subject_id, text FROM seqs JOIN rows_split USING (subject_id) WHERE split = 'test'",
    "sampled_dataset": f"""
    SELECT subject_id, split FROM rows_split
    QUALIFY row_number() OVER (PARTITION BY split ORDER BY {md5_of(42, 'subject_id')}) <= 50""",
    "evaluation_set_round_trip": """
    SELECT subject_id, task, cast(end_visit AS integer) AS stopping_time, label AS label_token
    FROM many_valid JOIN many_label USING (subject_id, task)""",
    "prediction_csv_round_trip": """
    SELECT subject_id, label_token, coalesce(texts, '') AS generated_text,
      round(list_avg(scores), 9) AS probability_agg, 'steps' AS model_name FROM preds""",
}
FINAL["subject_losses"] = FINAL["example_losses"]
FINAL["subject_loss_round_trip"] = FINAL["example_losses"]
FINAL["event_csv_round_trip"] = FINAL["split_events"]
FINAL["sequence_csv_round_trip"] = FINAL["curated_sequences"]
FINAL["vocabulary_round_trip"] = FINAL["vocabulary"]
FINAL["dictionary_round_trip"] = FINAL["data_dictionary"]

NAMES = re.compile(r"\b(" + "|".join(sorted(CTES, key=len, reverse=True)) + r")\b")


def needed(sql: str) -> list[str]:
    """CTEs that a statement uses, in order of dependence."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in dict.fromkeys(NAMES.findall(body)):
            if name not in order and CTES[name] is not body:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def statements() -> dict[str, str]:
    out = {}
    for name, final in FINAL.items():
        final = final.strip()
        ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed(final))
        if final.startswith("WITH "):
            out[name] = f"WITH {ctes},\n{final[5:]}" if ctes else final
        else:
            out[name] = f"WITH {ctes}\n{final}" if ctes else final
    return out
