"""Schemas of the tables the operators exchange."""

from __future__ import annotations

MCQ = "id string, question string, opa string, opb string, opc string, opd string, cop int, exp string, " \
      "subject_name string, topic_name string"
LITERATURE = "pubid long, question string, long_answer string, final_decision string, " \
             "context struct<contexts:array<string>,labels:array<string>,meshes:array<string>>"
CONSUMER = "question_id string, question_type string, question string, answer string"
DIALOGUE = "row_idx long, input string, output string"

CATEGORIZED = "id string, dataset string, subject_name string, topic_name string, question string, " \
              "primary_category string, secondary_category string, quality_tier string, has_explanation boolean"
CATEGORIZED_COLUMNS = [column.split()[0] for column in CATEGORIZED.split(", ")]
CHUNK = "source_table string, source_id string, chunk_text string, embedding array<float>, model string"

EVAL_EXAMPLE = (
    "prompt_id string, prompt array<struct<role:string,content:string>>, "
    "rubrics array<struct<criterion:string,points:double,tags:array<string>>>, example_tags array<string>, "
    "ideal_completions_data struct<ideal_completion:string,ideal_completions_group:string,"
    "ideal_completions_ref_completions:array<string>>"
)
META_EXAMPLE = (
    "prompt_id string, completion_id string, category string, prompt array<struct<role:string,content:string>>, "
    "completion string, rubric string, binary_labels array<boolean>, anonymized_physician_ids array<string>"
)
RESULT_EXAMPLE = (
    "struct<prompt_id:string,score:double,prompt:array<struct<role:string,content:string>>,"
    "completion:array<struct<role:string,content:string>>,"
    "usage:struct<input_tokens:long,output_tokens:long,prompt_tokens:long,completion_tokens:long,total_tokens:long>,"
    "rubric_items:array<struct<criterion:string,points:double,tags:array<string>,criteria_met:boolean,"
    "explanation:string>>>"
)
RESULT_FILE = f"metadata struct<example_level_metadata:array<{RESULT_EXAMPLE}>>"

PROFILE = (
    "user_id string, age int, sex string, health_literacy string, "
    "conditions array<struct<name:string,category_id:string,subcategory_id:string,active:boolean>>, "
    "medications array<struct<name:string,category_id:string>>"
)
