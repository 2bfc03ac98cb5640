"""Schemas of the input tables, as DDL."""

QA = "struct<question:string,exe_ans:variant,program:string,gold_inds:map<string,string>>"
RAW_RECORD = f"id string, table array<array<string>>, qa {QA}, qa_0 {QA}, qa_1 {QA}"
EXAMPLE = (
    "question string, text string, table string, answer variant, program string, id string, gold map<string,string>"
)
COMPLETION_CHOICES = (
    "id string, choices array<struct<text:string,message:struct<role:string,content:string>,"
    "logprobs:struct<token_logprobs:array<double>>>>"
)
COMPLETION = "id string, sample_idx int, text string, token_logprobs array<double>"
GOLD_DOCUMENT = (
    "questions array<struct<uid:string,answer_type:string,answer_from:string,scale:string,answer:variant>>"
)
