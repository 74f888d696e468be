"""DuckDB SQL for each query, written on its own from the meaning of the query.

``_TABLES`` spells the sample tables a second time, so the adapter is checked as well.
"""

from __future__ import annotations

_TABLES = """
WITH person AS (
  SELECT c_custkey AS person_id, c_nationkey AS gender_concept_id,
    CASE WHEN c_custkey % 10 = 9 THEN 99 ELSE CAST(c_custkey % 4 AS INT) END AS sex_at_birth_concept_id,
    24 - c_nationkey AS self_reported_category_concept_id,
    CASE c_nationkey % 7 WHEN 0 THEN 8527 WHEN 1 THEN 8516 WHEN 2 THEN 8515 WHEN 3 THEN 8522
      WHEN 4 THEN 8657 WHEN 5 THEN 2000000001 END AS race_concept_id,
    CASE WHEN c_nationkey % 5 = 0 THEN 38003563 ELSE 38003564 END AS ethnicity_concept_id,
    CAST(DATE '1930-01-01' + CAST((c_custkey * 3697) % 28000 AS INT) AS TIMESTAMP) AS birth_datetime
  FROM customer),
concept AS (
  SELECT n_nationkey AS concept_id,
    CASE n_nationkey WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN 'Intersex' ELSE n_name END AS concept_name
  FROM nation),
availability AS (
  SELECT c_custkey AS person_id,
    CAST(c_acctbal > 5000 AS INT) AS has_whole_genome_variant,
    CAST(c_nationkey = 3 AS INT) AS has_lr_whole_genome_variant,
    CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INT) AS has_array_data,
    CAST(c_custkey % 11 = 0 AS INT) AS has_structural_variant_data
  FROM customer),
deaths AS (
  SELECT c_custkey AS person_id, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS death_date,
    CAST(c_custkey % 3 AS INT) AS death_type_concept_id,
    CASE WHEN c_nationkey > 4 THEN c_nationkey END AS cause_concept_id,
    c_acctbal < -500 AS primary_death_record, c_mktsegment AS src_id
  FROM customer WHERE c_acctbal < 0),
variant_people AS (
  SELECT DISTINCT o_custkey AS person_id FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 3),
picked AS (
  SELECT o_custkey AS person_id, o_orderkey AS k,
    CASE WHEN o_orderkey % 5 = 4 OR o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 5)
      THEN o_orderkey % 5 ELSE 5 END AS q
  FROM orders),
coded AS (SELECT person_id, q, (k + person_id) % 7 AS a FROM picked),
survey AS (
  SELECT person_id,
    CASE q WHEN 0 THEN 1586198 WHEN 1 THEN 1586201 WHEN 2 THEN 1586207 WHEN 3 THEN 1586213 WHEN 4 THEN 1586151 ELSE 1586140 END
      AS question_concept_id,
    CASE q WHEN 0 THEN 'Alcohol: Alcohol Participant' WHEN 1 THEN 'Alcohol: Drink Frequency Past Year'
      WHEN 2 THEN 'Alcohol: Average Daily Drink Count' WHEN 3 THEN 'Alcohol: 6 or More Drinks Occurrence'
      WHEN 4 THEN 'Race: What Race Ethnicity' ELSE 'Race: Race And Ethnicity' END AS question,
    CASE WHEN a = 6 THEN NULL
      WHEN a = 5 THEN CASE WHEN q IN (1, 4) THEN 'PMI: Prefer Not To Answer' ELSE 'PMI: Skip' END
      WHEN q = 0 THEN CASE WHEN a < 3 THEN 'Alcohol Participant: Yes' ELSE 'Alcohol Participant: No' END
      WHEN q = 1 THEN 'Drink Frequency Past Year: ' || CASE a WHEN 0 THEN 'Never' WHEN 1 THEN 'Monthly Or Less'
        WHEN 2 THEN '2 to 4 Per Month' WHEN 3 THEN '2 to 3 Per Week' ELSE '4 or More Per Week' END
      WHEN q = 2 THEN 'Average Daily Drink Count: ' || CASE a WHEN 0 THEN '1 or 2' WHEN 1 THEN '3 or 4'
        WHEN 2 THEN '5 or 6' WHEN 3 THEN '7 to 9' ELSE '10 or More' END
      WHEN q = 3 THEN '6 or More Drinks Occurrence: ' || CASE a WHEN 0 THEN 'Never In Last Year'
        WHEN 1 THEN 'Less Than Monthly' ELSE 'Monthly' END
      WHEN q = 5 THEN CASE a WHEN 0 THEN 'What Race Ethnicity: Asian' WHEN 1 THEN 'What Race Ethnicity: None of these,' || chr(10) || '"as I see it"'
        WHEN 2 THEN 'Asian Specific: Chinese' WHEN 3 THEN 'Asian Specific: Korean' ELSE 'What Race Ethnicity: White' END
      ELSE 'Asian Specific: ' || CASE a WHEN 0 THEN 'Chinese' WHEN 1 THEN 'Japanese' WHEN 2 THEN 'Korean'
        WHEN 3 THEN 'Filipino' ELSE 'Vietnamese' END END AS answer,
    'wave ' || q AS survey_version_name
  FROM coded),
raced AS (
  SELECT *, CASE WHEN ethnicity_concept_id = 38003563 THEN 'Hispanic or Latino'
      WHEN race_concept_id = 8527 THEN 'White' WHEN race_concept_id = 8516 THEN 'Black or African American'
      WHEN race_concept_id = 8515 THEN 'Asian' WHEN race_concept_id = 8522 THEN 'American Indian or Alaska Native'
      WHEN race_concept_id = 8657 THEN 'Native Hawaiian or Other Pacific Islander'
      WHEN race_concept_id = 2000000001 THEN 'More than one race' ELSE 'Other/Unknown' END AS race_ethnicity
  FROM person),
flagged AS (
  SELECT DISTINCT person_id FROM availability WHERE has_whole_genome_variant = 1 OR has_lr_whole_genome_variant = 1
    OR has_array_data = 1 OR has_structural_variant_data = 1),
initial AS (
  SELECT r.person_id, r.race_ethnicity FROM raced r WHERE EXISTS (SELECT 1 FROM flagged f WHERE f.person_id = r.person_id)),
cohort AS (
  SELECT * FROM initial i WHERE NOT EXISTS (SELECT 1 FROM deaths d WHERE d.person_id = i.person_id)),
halves AS (
  SELECT c.*, CASE WHEN v.person_id IS NULL THEN 'noncarriers' ELSE 'carriers' END AS half
  FROM cohort c LEFT JOIN variant_people v ON c.person_id = v.person_id),
demo AS (
  SELECT p.person_id, p.birth_datetime AS date_of_birth, p.race_concept_id, p.ethnicity_concept_id,
    g.concept_name AS gender, s.concept_name AS sex_at_birth, r.concept_name AS self_reported_category,
    2024 - year(birth_datetime)
      - CASE WHEN 101 < month(birth_datetime) * 100 + day(birth_datetime) THEN 1 ELSE 0 END AS age
  FROM person p LEFT JOIN concept g ON p.gender_concept_id = g.concept_id
    LEFT JOIN concept s ON p.sex_at_birth_concept_id = s.concept_id
    LEFT JOIN concept r ON p.self_reported_category_concept_id = r.concept_id),
aged AS (
  SELECT h.*, d.date_of_birth, d.gender, d.sex_at_birth, d.age,
    CASE WHEN age BETWEEN 18 AND 29 THEN '18-29' WHEN age BETWEEN 30 AND 39 THEN '30-39'
      WHEN age BETWEEN 40 AND 49 THEN '40-49' WHEN age BETWEEN 50 AND 59 THEN '50-59'
      WHEN age BETWEEN 60 AND 69 THEN '60-69' WHEN age BETWEEN 70 AND 79 THEN '70-79'
      WHEN age BETWEEN 80 AND 89 THEN '80-89' WHEN age >= 90 THEN '90+' END AS age_group,
    CASE WHEN d.sex_at_birth IN ('Male', 'Female') THEN d.sex_at_birth ELSE 'Other' END AS sex
  FROM halves h JOIN demo d ON h.person_id = d.person_id),
valid AS (
  SELECT * FROM survey WHERE answer IS NULL OR NOT regexp_matches(answer, 'PMI|Skip|Prefer Not To Answer', 'i')),
refused AS (SELECT * FROM (VALUES ('PMI: Prefer Not To Answer'), ('PMI: Skip')) t(answer)),
unrefused AS (SELECT * FROM survey WHERE answer IS NULL OR answer NOT IN (SELECT answer FROM refused)),
ranks AS (
  SELECT * FROM (VALUES
    ('Drink Frequency Past Year: Never', 1), ('Drink Frequency Past Year: Monthly Or Less', 2),
    ('Drink Frequency Past Year: 2 to 4 Per Month', 3), ('Drink Frequency Past Year: 2 to 3 Per Week', 4),
    ('Drink Frequency Past Year: 4 or More Per Week', 5), ('Average Daily Drink Count: 1 or 2', 6),
    ('Average Daily Drink Count: 3 or 4', 7), ('Average Daily Drink Count: 5 or 6', 8),
    ('Average Daily Drink Count: 7 to 9', 9), ('Average Daily Drink Count: 10 or More', 10)) t(answer, pos)),
single_subgroup AS (
  SELECT person_id, min(answer) AS answer FROM survey WHERE question_concept_id = 1586151
  GROUP BY person_id HAVING count(*) = 1),
known_carriers AS (SELECT person_id FROM variant_people WHERE person_id IN (SELECT person_id FROM availability)),
race_rows AS (
  SELECT r.race_ethnicity, v.person_id IN (SELECT person_id FROM known_carriers) AS carrier, r.person_id,
    CASE v.question_concept_id WHEN 1586198 THEN 'Lifetime Use: ' WHEN 1586201 THEN 'Frequency: '
      WHEN 1586207 THEN 'Quantity: ' ELSE 'Other: ' END || coalesce(v.answer, 'NA') AS category,
    v.question_concept_id
  FROM raced r JOIN valid v ON r.person_id = v.person_id),
long_rows AS (
  SELECT race_ethnicity, carrier, person_id, question_concept_id,
    CASE WHEN question_concept_id = 1586213 THEN replace(category, 'Other: ', 'Binge (6+): ') ELSE category END AS category
  FROM race_rows),
lookup AS (
  SELECT DISTINCT s.person_id, replace(s.answer, 'Asian Specific: ', '') AS detailed_race,
    s.person_id IN (SELECT person_id FROM known_carriers) AS carrier
  FROM survey s JOIN person p ON s.person_id = p.person_id
  WHERE p.race_concept_id = 8515 AND s.answer ILIKE '%Asian Specific:%'),
subgroup_rows AS (
  SELECT l.person_id, l.detailed_race AS race_ethnicity, l.carrier, v.question_concept_id,
    regexp_replace(v.answer,
      'Drink Frequency Past Year: |Average Daily Drink Count: |6 or More Drinks Occurrence: |Alcohol Participant: ', '', 'g')
      AS clean_answer, v.answer
  FROM lookup l JOIN valid v ON l.person_id = v.person_id WHERE v.question_concept_id NOT IN (1586151, 1586140)),
subgroup_cats AS (
  SELECT *, CASE question_concept_id WHEN 1586198 THEN 'Lifetime Use: ' WHEN 1586201 THEN 'Frequency: '
      WHEN 1586207 THEN 'Quantity: ' WHEN 1586213 THEN 'Binge (6+): ' END AS prefix
  FROM subgroup_rows),
outcomes AS (
  SELECT * FROM (
    SELECT person_id, race_ethnicity,
      CASE WHEN max(CASE WHEN question_concept_id = 1586198 THEN clean_answer END) = 'No' THEN 'Nondrinker'
        WHEN max(CASE WHEN question_concept_id = 1586201 THEN clean_answer END) = 'Never in past year' THEN 'Nondrinker'
        ELSE max(CASE WHEN question_concept_id = 1586201 THEN clean_answer END) END AS drinking_frequency
    FROM subgroup_rows WHERE carrier GROUP BY person_id, race_ethnicity) t
  WHERE drinking_frequency IS NOT NULL),
model_cells AS (SELECT race_ethnicity AS g, drinking_frequency AS k, count(*) AS n FROM outcomes GROUP BY ALL),
ref AS (SELECT g FROM model_cells GROUP BY g ORDER BY sum(n) DESC, g LIMIT 1),
grid AS (
  SELECT gs.g, ks.k, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT g FROM model_cells) gs CROSS JOIN (SELECT DISTINCT k FROM model_cells) ks
    LEFT JOIN model_cells c ON c.g = gs.g AND c.k = ks.k),
terms AS (
  SELECT a.k AS outcome, CASE WHEN a.g = (SELECT g FROM ref) THEN '(Intercept)' ELSE a.g END AS term, a.n AS cell_n,
    a.n > 0 AND b.n > 0 AND r.n > 0 AND rb.n > 0 AS finite,
    CASE WHEN a.n > 0 AND b.n > 0 AND r.n > 0 AND rb.n > 0 THEN
      CASE WHEN a.g = (SELECT g FROM ref) THEN ln(a.n / b.n) ELSE ln(a.n / b.n) - ln(r.n / rb.n) END END AS estimate,
    CASE WHEN a.n > 0 AND b.n > 0 AND r.n > 0 AND rb.n > 0 THEN
      sqrt(1.0 / a.n + 1.0 / b.n + CASE WHEN a.g = (SELECT g FROM ref) THEN 0 ELSE 1.0 / r.n + 1.0 / rb.n END) END AS std_error
  FROM grid a JOIN grid b ON b.g = a.g AND b.k = 'Nondrinker'
    JOIN grid r ON r.k = a.k AND r.g = (SELECT g FROM ref)
    JOIN grid rb ON rb.k = 'Nondrinker' AND rb.g = (SELECT g FROM ref)
  WHERE a.k <> 'Nondrinker')
"""

_FIRST_ORDER = """
  SELECT * FROM (VALUES ('Lifetime Use: Alcohol Participant: Yes', 1),
    ('Frequency: Drink Frequency Past Year: Monthly Or Less', 2), ('Frequency: 2 to 4 times a month', 3),
    ('Frequency: 2 to 3 times a week', 4), ('Frequency: 4 or more times a week', 5),
    ('Quantity: Average Daily Drink Count: 1 or 2', 6), ('Quantity: Average Daily Drink Count: 3 or 4', 7),
    ('Quantity: Average Daily Drink Count: 5 or 6', 8), ('Quantity: Average Daily Drink Count: 7 to 9', 9),
    ('Quantity: Average Daily Drink Count: 10 or More', 10),
    ('Binge (6+): 6 or More Drinks Occurrence: Never In Last Year', 11),
    ('Binge (6+): 6 or More Drinks Occurrence: Less Than Monthly', 12),
    ('Binge (6+): 6 or More Drinks Occurrence: Monthly', 13)) t(category, pos)"""
_CLEAN_ORDER = """
  SELECT * FROM (VALUES ('Lifetime Use: Yes', 1), ('Frequency: Monthly Or Less', 2),
    ('Frequency: 2 to 4 times a month', 3), ('Frequency: 2 to 3 times a week', 4),
    ('Frequency: 4 or more times a week', 5), ('Quantity: 1 or 2', 6), ('Quantity: 3 or 4', 7),
    ('Quantity: 5 or 6', 8), ('Quantity: 7 to 9', 9), ('Quantity: 10 or More', 10),
    ('Binge (6+): Never In Last Year', 11), ('Binge (6+): Less Than Monthly', 12),
    ('Binge (6+): Monthly', 13)) t(category, pos)"""
_RACES = ["American Indian or Alaska Native", "Asian", "Black or African American", "Hispanic or Latino",
          "More than one race", "Native Hawaiian or Other Pacific Islander", "Other/Unknown", "White"]
_NAMED = ["Chinese", "Filipino", "Japanese", "Korean", "Vietnamese"]


def _cells(rows: str) -> str:
    return f"SELECT category, race_ethnicity, count(*) AS n FROM ({rows}) src GROUP BY ALL"


def _sums(groups: list[str]) -> str:
    return ", ".join(f"""CAST(coalesce(sum(CASE WHEN race_ethnicity = '{g}' THEN n END), 0) AS BIGINT) AS "{g}" """
                     for g in groups)


def _crosstab(rows: str, groups: list[str], order: str) -> str:
    """Category rows in report order, then the totals; written without grouping sets."""
    total = 'CAST(sum(n) AS BIGINT) AS "Total (All Groups)"'
    return f"""
SELECT CAST(row_number() OVER (ORDER BY is_total, coalesce(pos, 1000), first_group, t.category) AS INT) AS row_number,
  t.* EXCLUDE (is_total, first_group)
FROM (
  SELECT 0 AS is_total, category, min(race_ethnicity) AS first_group, {_sums(groups)}, {total}
  FROM ({_cells(rows)}) c GROUP BY category
  UNION ALL
  SELECT 1, 'Total Participants', NULL, {_sums(groups)}, {total} FROM ({_cells(rows)}) c) t
LEFT JOIN ({order}) o ON o.category = t.category"""


_NP = "count || ' (' || printf('%.2f', percent) || '%)' AS value"


def _distribution(key: str, condition: str, alias: str | None = None) -> str:
    return f"""
SELECT {key} AS {alias or key}, n_people, CAST(printf('%.2f', 100.0::DOUBLE * n_people / total) AS DOUBLE) AS percent
FROM (SELECT {key}, count(*) AS n_people, CAST(sum(count(*)) OVER () AS DOUBLE) AS total
      FROM aged WHERE {condition} GROUP BY {key}) t"""


def _ordered(source: str, rank: str, label: str, last: int, by: str = "") -> str:
    """Counts, percent text and Total; ``source`` gives answer rows, ``rank`` and ``label`` use ``answer``."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT {keys} row_order, answer, count, printf('%.2f', percent) AS percent FROM (
  WITH c AS (
    SELECT {keys} answer, count(*) AS count, 100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER ({part}) AS DOUBLE) AS percent
    FROM ({source}) src GROUP BY {keys} answer)
  SELECT {keys} CAST({rank} AS INT) AS row_order, {label} AS answer, count, percent FROM c
  UNION ALL
  SELECT {keys} {last}, 'Total', CAST(sum(count) AS BIGINT), sum(percent) FROM c {"GROUP BY " + by if by else ""}) t"""


def _stratified(source: str, by: str, group: str, order: str) -> str:
    return f"""
SELECT {by}, {group}, pos AS row_order, answer, count, percent, {_NP}
FROM (
  SELECT {by}, {group}, pos, answer, count(*) AS count,
    100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER (PARTITION BY {by}, {group}) AS DOUBLE) AS percent
  FROM (SELECT s.{by}, s.{group}, o.pos, o.answer FROM ({source}) s LEFT JOIN ({order}) o ON s.answer = o.answer) x
  GROUP BY {by}, {group}, pos, answer) t"""


_SUBGROUP_SOURCE = """
SELECT h.half, g.answer AS subgroup, {answer} AS answer
FROM unrefused s JOIN halves h ON s.person_id = h.person_id JOIN single_subgroup g ON g.person_id = s.person_id
WHERE s.question_concept_id = {question} AND h.race_ethnicity = 'Asian' AND s.answer IS NOT NULL AND g.answer IS NOT NULL"""
_FREQ_SOURCE = _SUBGROUP_SOURCE.format(answer="s.answer", question=1586201)
_QTY_SOURCE = _SUBGROUP_SOURCE.format(
    answer="CASE WHEN s.answer = 'Average Daily Drink Count: 1 or 2' THEN '1–2 drinks' ELSE '3+ drinks' END",
    question=1586207)
_FREQ_RANKS = "SELECT CAST(pos AS INT) AS pos, answer FROM ranks WHERE pos <= 5"
_ALL_RANKS = "SELECT CAST(CASE WHEN pos > 5 THEN pos - 5 ELSE pos END AS INT) AS pos, answer FROM ranks"
_QTY_RANKS = "SELECT * FROM (VALUES (1, '1–2 drinks'), (2, '3+ drinks')) t(pos, answer)"

_BY_COHORT = """
SELECT h.cohort, s.question, s.answer FROM {survey} s JOIN (
  SELECT person_id, half AS cohort FROM halves UNION ALL
  SELECT person_id, half || ' (Asian)' FROM halves WHERE race_ethnicity = 'Asian') h ON s.person_id = h.person_id
WHERE s.question_concept_id IN ({questions})"""

_CARRIER_RACE = "SELECT * FROM long_rows WHERE carrier AND question_concept_id NOT IN (1586151, 1586140)"
_OTHER_RACE = """SELECT * FROM long_rows WHERE person_id NOT IN (SELECT person_id FROM variant_people)
  AND question_concept_id NOT IN (1586151, 1586140)"""
_CARRIER_SUB = """SELECT race_ethnicity, prefix || coalesce(clean_answer, 'NA') AS category FROM subgroup_cats WHERE carrier"""
_OTHER_SUB = """SELECT race_ethnicity, prefix || coalesce(answer, 'NA') AS category FROM subgroup_cats
  WHERE person_id NOT IN (SELECT person_id FROM variant_people)"""

# Simpson's rule on the normal density from 0 to |z|; 2000 steps are exact to about 1e-12 here.
_PVALUES = """
SELECT outcome, term, round(1.0 - 2.0 * (h / 3.0) * list_sum(list_transform(generate_series(0, 2000),
    lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * h) * (i * h) / 2.0)))
    / sqrt(2.0 * pi()), 9) AS p_value
FROM (SELECT outcome, term, abs(estimate / std_error) / 2000.0 AS h FROM terms) t"""

_BODIES = {
    "survey_scan": "SELECT person_id, question, answer, survey_version_name FROM survey WHERE question_concept_id NOT IN (1586151, 1586140)",
    "cohort_person_scan": """SELECT person_id, CAST(date_of_birth AS VARCHAR) AS date_of_birth, race_concept_id,
        ethnicity_concept_id, gender, sex_at_birth, self_reported_category
        FROM demo WHERE person_id IN (SELECT person_id FROM flagged)""",
    "person_demographics": "SELECT person_id, CAST(date_of_birth AS VARCHAR) AS date_of_birth, gender, sex_at_birth FROM demo",
    "deaths_distinct": "SELECT DISTINCT * FROM deaths",
    "sql_to_frame": """SELECT DISTINCT person_id, death_date FROM deaths
        WHERE death_date >= DATE '2021-01-01' AND death_type_concept_id IN (0, 2)""",
    "na_tokens": """SELECT c_custkey AS person_id,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS answer FROM customer""",
    "cast_keys": """SELECT c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END AS person_id,
        CAST(c_nationkey AS BIGINT) AS race_concept_id FROM customer""",
    "csv_roundtrip": "SELECT person_id, question_concept_id, question, answer FROM survey",
    "race_label": "SELECT * FROM initial",
    "race_counts": "SELECT race_ethnicity, count(DISTINCT person_id) AS n_people FROM initial GROUP BY race_ethnicity",
    "split_by_question": """SELECT person_id, question, answer FROM survey
        WHERE question = 'Alcohol: Drink Frequency Past Year'""",
    "drop_refusals": "SELECT person_id, question_concept_id, answer FROM unrefused",
    "valid_answers": "SELECT person_id, question_concept_id, answer FROM valid",
    "regex_categories": "SELECT person_id, race_ethnicity, category FROM long_rows",
    "clean_answer": """SELECT person_id, answer, regexp_replace(answer,
        'Drink Frequency Past Year: |Average Daily Drink Count: |6 or More Drinks Occurrence: |Alcohol Participant: ',
        '', 'g') AS clean_answer FROM survey""",
    "collapse_levels": """SELECT person_id, CASE WHEN answer = 'Average Daily Drink Count: 1 or 2' THEN '1–2 drinks'
        WHEN answer LIKE 'Average%' THEN '3+ drinks' END AS drinks FROM survey WHERE question_concept_id = 1586207""",
    "split_category": """SELECT person_id, answer AS category, split_part(answer, ': ', 1) AS question_group,
        CASE WHEN instr(answer, ': ') > 0 THEN substr(answer, instr(answer, ': ') + 2) END AS rest FROM survey""",
    "variant_carriers": "SELECT person_id FROM variant_people",
    "any_flag_cohort": """SELECT person_id FROM availability WHERE has_whole_genome_variant = 1
        UNION SELECT person_id FROM availability WHERE has_lr_whole_genome_variant = 1
        UNION SELECT person_id FROM availability WHERE has_array_data = 1
        UNION SELECT person_id FROM availability WHERE has_structural_variant_data = 1""",
    "any_flag_or": "SELECT person_id FROM flagged",
    "genotyped_people": """SELECT person_id, race_ethnicity,
        CAST(person_id IN (SELECT person_id FROM flagged) AS INT) AS gene FROM raced""",
    "genotyped_race_table": """SELECT race_ethnicity, count(*) AS n FROM raced
        WHERE person_id IN (SELECT person_id FROM flagged) GROUP BY race_ethnicity""",
    "cohort_semi_join": "SELECT person_id, race_ethnicity FROM halves WHERE half = 'carriers'",
    "cohort_anti_join": "SELECT person_id, race_ethnicity FROM halves WHERE half = 'noncarriers'",
    "anti_via_left": "SELECT person_id, race_ethnicity FROM halves WHERE half = 'noncarriers'",
    "not_in_scan": "SELECT person_id FROM person WHERE person_id NOT IN (SELECT person_id FROM variant_people)",
    "not_in_null_aware": """
        SELECT 'ids' AS list, count(*) AS n FROM person WHERE person_id NOT IN (SELECT person_id FROM variant_people)
        UNION ALL SELECT 'missing ids', count(*) FROM person
          WHERE person_id NOT IN (SELECT CASE WHEN primary_death_record THEN person_id END FROM deaths)
        UNION ALL SELECT 'empty', count(*) FROM person
          WHERE person_id NOT IN (SELECT person_id FROM deaths WHERE death_date < DATE '1900-01-01')""",
    "membership_flag": """SELECT person_id, CASE WHEN person_id IN (SELECT person_id FROM variant_people) THEN 1 ELSE 0 END
        AS gene FROM person""",
    "ids_in_both": "SELECT person_id FROM flagged INTERSECT SELECT person_id FROM deaths",
    "ids_missing": "SELECT person_id FROM known_carriers EXCEPT SELECT person_id FROM cohort",
    "single_answer_only": "SELECT person_id, answer FROM single_subgroup",
    "left_join_suffix": """SELECT a.person_id, a.answer AS answer_x, count(*) AS n, b.answer AS answer_y
        FROM survey a JOIN single_subgroup b ON a.person_id = b.person_id
        WHERE a.question_concept_id = 1586201 AND a.answer IS NOT NULL AND b.answer IS NOT NULL GROUP BY ALL""",
    "answers_by_group": """SELECT i.person_id, i.race_ethnicity, u.answer, count(*) AS n FROM initial i
        JOIN unrefused u ON u.person_id = i.person_id WHERE u.question_concept_id = 1586201 AND u.answer IS NOT NULL
        GROUP BY ALL""",
    "cohort_with_demographics": """SELECT person_id, race_ethnicity, CAST(date_of_birth AS VARCHAR) AS date_of_birth,
        gender, sex_at_birth, CAST(age AS INT) AS age, age_group FROM aged WHERE half = 'carriers'""",
    "breakdown_full_join": """SELECT coalesce(a.race_ethnicity, b.race_ethnicity) AS race_ethnicity, with_variant, without_variant
        FROM (SELECT race_ethnicity, count(*) AS with_variant FROM halves WHERE half = 'carriers' GROUP BY 1) a
        FULL JOIN (SELECT race_ethnicity, count(*) AS without_variant FROM halves WHERE half = 'noncarriers' GROUP BY 1) b
        ON a.race_ethnicity = b.race_ethnicity""",
    "multi_select_lookup": "SELECT person_id, detailed_race FROM lookup WHERE carrier",
    "stack_by_name": """SELECT person_id, death_date, NULL AS race_ethnicity FROM deaths UNION ALL
        SELECT person_id, NULL, race_ethnicity FROM halves WHERE half = 'carriers'""",
    "count_by_key": "SELECT answer, count(*) AS count FROM survey GROUP BY answer",
    "count_by_two_keys": "SELECT question, answer, count(*) AS count FROM survey GROUP BY question, answer",
    "distinct_people_by_group": "SELECT answer, count(DISTINCT person_id) AS n_people FROM survey GROUP BY answer",
    "distinct_people": """SELECT count(DISTINCT person_id) AS n_people,
        count(DISTINCT coalesce(answer, '<none>')) AS n_answers, count(*) AS n_rows FROM survey""",
    "distinct_people_rollup": """SELECT h.race_ethnicity, h.half, s.question_concept_id,
        CAST(GROUPING(h.race_ethnicity, h.half, s.question_concept_id) AS BIGINT) AS level, count(DISTINCT s.person_id) AS n_people
        FROM survey s JOIN halves h ON s.person_id = h.person_id
        GROUP BY CUBE (h.race_ethnicity, h.half, s.question_concept_id)""",
    "duplicate_keys": """SELECT person_id, count(*) AS n FROM survey WHERE question_concept_id = 1586151
        GROUP BY person_id HAVING count(*) > 1""",
    "distinct_values": "SELECT DISTINCT answer FROM survey",
    "freq_table_nonnull": "SELECT answer, count(*) AS n FROM survey WHERE answer IS NOT NULL GROUP BY answer",
    "freq_n_way": """SELECT CAST(person_id IN (SELECT person_id FROM flagged) AS INT) AS gene, race_ethnicity, count(*) AS n
        FROM raced GROUP BY ALL""",
    "percent_table": """SELECT answer, count(*) AS count,
        100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS percent FROM survey GROUP BY answer""",
    "largest_group": """SELECT answer, count(*) AS n FROM survey WHERE question_concept_id = 1586151 AND answer IS NOT NULL
        GROUP BY answer ORDER BY n DESC, answer LIMIT 1""",
    "head_rows": """SELECT person_id, question, answer FROM survey
        ORDER BY person_id, question, answer NULLS FIRST LIMIT 5""",
    "reconcile_counts": """
        WITH t AS (SELECT count(*) AS everyone, count(*) FILTER (half = 'carriers') AS yes,
          count(*) FILTER (half = 'noncarriers') AS no, count(*) FILTER (race_ethnicity = 'Asian') AS grp FROM halves),
        k AS (SELECT count(*) AS known FROM known_carriers)
        SELECT "check", CAST(total AS BIGINT) AS left_total, CAST(total AS BIGINT) AS right_total, TRUE AS agrees FROM (
          SELECT 'carriers + non-carriers = cohort' AS "check", everyone AS total FROM t
          UNION ALL SELECT 'carriers - missing = carriers in cohort', known FROM k
          UNION ALL SELECT 'age table = carriers', yes FROM t
          UNION ALL SELECT 'sex table = carriers', yes FROM t
          UNION ALL SELECT 'age table = non-carriers', no FROM t
          UNION ALL SELECT 'sex table = non-carriers', no FROM t
          UNION ALL SELECT 'one group, both halves = group', grp FROM t) x""",
    "age_distribution": _distribution("age_group", "half = 'carriers'"),
    "age_distribution_noncarriers": _distribution("age_group", "half = 'noncarriers'"),
    "sex_distribution": _distribution("sex", "half = 'carriers'", "sex_at_birth"),
    "sex_distribution_noncarriers": _distribution("sex", "half = 'noncarriers'", "sex_at_birth"),
    "group_age_distribution": _distribution("age_group", "half = 'carriers' AND race_ethnicity = 'Asian'"),
    "group_sex_distribution": _distribution("sex", "half = 'carriers' AND race_ethnicity = 'Asian'", "sex_at_birth"),
    "group_age_distribution_noncarriers": _distribution("age_group", "half = 'noncarriers' AND race_ethnicity = 'Asian'"),
    "group_sex_distribution_noncarriers": _distribution(
        "sex", "half = 'noncarriers' AND race_ethnicity = 'Asian'", "sex_at_birth"),
    "age_range_count": "SELECT count(*) AS n_18_21 FROM aged WHERE half = 'noncarriers' AND age BETWEEN 18 AND 21",
    "ordered_table_total": _ordered(
        "SELECT answer FROM unrefused WHERE question_concept_id = 1586201",
        "coalesce((SELECT pos FROM ranks r WHERE r.answer = c.answer AND pos <= 5), 6)",
        "CASE WHEN answer IN (SELECT answer FROM ranks WHERE pos <= 5) THEN answer END", 7),
    "plain_table_total": _ordered("SELECT answer FROM unrefused WHERE question_concept_id = 1586207", "1", "answer", 2),
    "answers_by_cohort": f"""SELECT cohort, question, answer, count(*) AS count
        FROM ({_BY_COHORT.format(survey="survey", questions="1586198, 1586201, 1586207, 1586213")}) src GROUP BY ALL""",
    "question_tables_by_cohort": _ordered(
        _BY_COHORT.format(survey="unrefused", questions="1586201, 1586207"),
        """coalesce((SELECT CASE WHEN pos > 5 THEN pos - 5 ELSE pos END FROM ranks r
          WHERE r.answer = c.answer AND (pos <= 5) = (c.question = 'Alcohol: Drink Frequency Past Year')), 6)""",
        "answer", 7, "cohort, question"),
    "stratified_np": _stratified("""
        SELECT u.question_concept_id, i.race_ethnicity, u.answer FROM unrefused u JOIN initial i ON u.person_id = i.person_id
        WHERE u.question_concept_id IN (1586201, 1586207) AND u.answer IS NOT NULL AND i.race_ethnicity IN
          ('White', 'Asian', 'Black or African American', 'Hispanic or Latino')""",
        "question_concept_id", "race_ethnicity", _ALL_RANKS),
    "stratified_np_wide": f"""SELECT half, row_order, answer, {", ".join(
        f'''max(CASE WHEN subgroup = 'Asian Specific: {g}' THEN value END) AS "Asian Specific: {g}" ''' for g in _NAMED)}
        FROM ({_stratified(_FREQ_SOURCE, "half", "subgroup", _FREQ_RANKS)}) s
        WHERE subgroup LIKE 'Asian%' GROUP BY half, row_order, answer""",
    "subgroup_frequency": _stratified(_FREQ_SOURCE, "half", "subgroup", _FREQ_RANKS),
    "subgroup_quantity": _stratified(_QTY_SOURCE, "half", "subgroup", _QTY_RANKS),
    "subgroup_distribution": """SELECT half, answer, count(*) AS count,
        100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER (PARTITION BY half) AS DOUBLE) AS percent
        FROM (SELECT h.half, g.answer FROM halves h JOIN single_subgroup g ON h.person_id = g.person_id
              WHERE h.race_ethnicity = 'Asian' AND g.answer IS NOT NULL) t GROUP BY half, answer""",
    "crosstab_wide": f"SELECT category, {_sums(_RACES)} FROM ({_cells(_CARRIER_RACE)}) c GROUP BY category",
    "fanout_crosstab": f"SELECT category, race_ethnicity, n AS count FROM ({_cells(_CARRIER_SUB)}) c",
    "crosstab_totals": _crosstab(_CARRIER_RACE, _RACES, _FIRST_ORDER),
    "crosstab_totals_noncarriers": _crosstab(_OTHER_RACE, _RACES, _FIRST_ORDER),
    "ordered_crosstab": _crosstab(_CARRIER_SUB, _NAMED, _CLEAN_ORDER),
    "ordered_crosstab_noncarriers": _crosstab(_OTHER_SUB, _NAMED, _FIRST_ORDER),
    "crosstab_report": _crosstab(_CARRIER_RACE, _RACES, _FIRST_ORDER),
    "unpivot_counts": f"""SELECT k.category, g.race_ethnicity, coalesce(c.n, 0) AS count
        FROM (SELECT DISTINCT category FROM ({_CARRIER_RACE}) r) k
        CROSS JOIN (SELECT unnest({_RACES}) AS race_ethnicity) g
        LEFT JOIN ({_cells(_CARRIER_RACE)}) c ON c.category = k.category AND c.race_ethnicity = g.race_ethnicity""",
    "plot_shares": f"""SELECT k.category, 'Frequency' AS question_group, substr(k.category, 12) AS answer, g.race_ethnicity,
        coalesce(c.n, 0) AS count,
        CAST(coalesce(c.n, 0) AS DOUBLE) / nullif(CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.race_ethnicity) AS DOUBLE), 0)
          AS share
        FROM (SELECT DISTINCT category FROM ({_CARRIER_SUB}) r WHERE category LIKE 'Frequency: %') k
        CROSS JOIN (SELECT DISTINCT race_ethnicity FROM ({_CARRIER_SUB}) r) g
        LEFT JOIN ({_cells(_CARRIER_SUB)}) c ON c.category = k.category AND c.race_ethnicity = g.race_ethnicity""",
    "pivot_list_unnest": """
        WITH one AS (SELECT person_id,
            max(CASE WHEN question_concept_id = 1586198 THEN answer END) AS answer_1586198,
            max(CASE WHEN question_concept_id = 1586201 THEN answer END) AS answer_1586201,
            max(CASE WHEN question_concept_id = 1586207 THEN answer END) AS answer_1586207,
            max(CASE WHEN question_concept_id = 1586213 THEN answer END) AS answer_1586213
          FROM valid WHERE question_concept_id <> 1586140 GROUP BY person_id)
        SELECT one.*, m.answer AS answer_1586151
        FROM one LEFT JOIN valid m ON m.person_id = one.person_id AND m.question_concept_id = 1586151""",
    "outcome_label": "SELECT person_id, race_ethnicity, drinking_frequency, CAST(1 AS BIGINT) AS n FROM outcomes",
    "multinomial_fit": """SELECT outcome, term, cell_n, finite, round(estimate, 9) AS estimate, round(std_error, 9) AS std_error,
        round(exp(estimate), 9) AS risk_ratio, round(estimate / std_error, 9) AS z FROM terms""",
    "multinomial_deviance": """SELECT round(deviance, 6) AS deviance, edf, round(deviance + 2 * edf, 6) AS aic FROM (
        SELECT -2.0 * sum(c.n * ln(c.n / t.size)) AS deviance,
          CAST((count(DISTINCT c.k) - 1) * count(DISTINCT c.g) AS BIGINT) AS edf
        FROM model_cells c JOIN (SELECT g, CAST(sum(n) AS DOUBLE) AS size FROM model_cells GROUP BY g) t ON t.g = c.g) x""",
    "multinomial_pvalues": _PVALUES,
    # With the interaction the model has a coefficient per cell, so log ratios of the cells' counts are its fit.
    "multinomial_two_factors": """
        WITH cells AS (
          SELECT a.sex AS a, CASE WHEN a.age < 55 THEN 'young' ELSE 'old' END AS b, s.answer AS k, count(*) AS n
          FROM survey s JOIN aged a ON s.person_id = a.person_id
          WHERE s.question_concept_id = 1586201 AND s.answer IN (SELECT answer FROM ranks WHERE pos <= 5) GROUP BY ALL),
        ra AS (SELECT a FROM cells GROUP BY a ORDER BY sum(n) DESC, a LIMIT 1),
        rb AS (SELECT b FROM cells GROUP BY b ORDER BY sum(n) DESC, b LIMIT 1),
        l AS (SELECT c.a, c.b, c.k AS outcome, ln(c.n / o.n) AS v, 1.0 / c.n + 1.0 / o.n AS e
          FROM cells c JOIN cells o ON o.a = c.a AND o.b = c.b AND o.k = 'Drink Frequency Past Year: Never' AND c.k <> o.k),
        t AS (
          SELECT x.outcome, CASE WHEN x.a = (FROM ra) AND x.b = (FROM rb) THEN '(Intercept)' WHEN x.b = (FROM rb) THEN x.a
              WHEN x.a = (FROM ra) THEN x.b ELSE x.a || ':' || x.b END AS term,
            x.v - CASE WHEN x.a <> (FROM ra) THEN left_.v ELSE 0 END - CASE WHEN x.b <> (FROM rb) THEN up.v ELSE 0 END
              + CASE WHEN x.a <> (FROM ra) AND x.b <> (FROM rb) THEN r.v WHEN x.a <> (FROM ra) OR x.b <> (FROM rb) THEN 0 ELSE 0 END AS estimate,
            sqrt(x.e + CASE WHEN x.a <> (FROM ra) THEN left_.e ELSE 0 END + CASE WHEN x.b <> (FROM rb) THEN up.e ELSE 0 END
              + CASE WHEN x.a <> (FROM ra) AND x.b <> (FROM rb) THEN r.e ELSE 0 END) AS std_error
          FROM l x JOIN l left_ ON left_.outcome = x.outcome AND left_.a = (FROM ra) AND left_.b = x.b
            JOIN l up ON up.outcome = x.outcome AND up.b = (FROM rb) AND up.a = x.a
            JOIN l r ON r.outcome = x.outcome AND r.a = (FROM ra) AND r.b = (FROM rb))
        SELECT outcome, term, TRUE AS finite, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
          round(exp(estimate), 6) AS risk_ratio, round(estimate / std_error, 6) AS z FROM t""",
}
_BODIES["bucketed_cohort"] = _BODIES["cohort_semi_join"]
_BODIES["race_breakdown"] = _BODIES["breakdown_full_join"]

ORACLE: dict[str, str] = {}
for _name, _body in _BODIES.items():
    _body = _body.strip()
    # A body with its own WITH goes below the shared tables as a derived table.
    ORACLE[_name] = _TABLES + (f"SELECT * FROM ({_body}) q" if _body.startswith("WITH") else _body)
