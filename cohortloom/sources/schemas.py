"""Schemas of the warehouse tables. Declared, so that opening a table starts no inference job.

All integers are BIGINT: the warehouse's own type, and 32-bit Parquet columns widen to it.
"""

PERSON = """person_id BIGINT, gender_concept_id BIGINT, birth_datetime TIMESTAMP, race_concept_id BIGINT,
    ethnicity_concept_id BIGINT, sex_at_birth_concept_id BIGINT, self_reported_category_concept_id BIGINT"""
CONCEPT = "concept_id BIGINT, concept_name STRING"
SURVEY = """person_id BIGINT, question_concept_id BIGINT, question STRING, answer STRING,
    survey_version_name STRING"""
AVAILABILITY = """person_id BIGINT, has_whole_genome_variant BIGINT, has_lr_whole_genome_variant BIGINT,
    has_array_data BIGINT, has_structural_variant_data BIGINT"""
VARIANTS = "vid STRING, person_ids ARRAY<BIGINT>"
DEATHS = """person_id BIGINT, death_date DATE, death_type_concept_id BIGINT, cause_concept_id BIGINT,
    primary_death_record BOOLEAN, src_id STRING"""

TABLES = {
    "person": PERSON,
    "concept": CONCEPT,
    "survey": SURVEY,
    "availability": AVAILABILITY,
    "variants": VARIANTS,
    "deaths": DEATHS,
}

# Names the tables carry in the warehouse.
WAREHOUSE_NAMES = {
    "person": "person",
    "concept": "concept",
    "survey": "ds_survey",
    "availability": "cb_search_person",
    "variants": "cb_variant_to_person",
    "deaths": "aou_death",
}
