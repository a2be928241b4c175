"""Schemas, as DDL, of the tables and nested values that the operators read and write."""

from __future__ import annotations

CITATION = "struct<source_marker:string,file_name:string,chunk_index:int,chunk_text:string,document_id:string,relevance_score:double>"
FACT_CHECK = "struct<label:string,confidence:double,probs:map<string,double>,needs_stage2:boolean,threshold:double,chunks_used:int>"

TABLES = {
    "users": "id string, email string, full_name string, status boolean, last_login timestamp, created_at timestamp",
    "papers": "id long, title string, authors string, abstract string, content string, publication_date date, category string, source_url string, created_at timestamp",
    "projects": "id string, user_id string, name string, domain string, description string, collection_name string, is_draft boolean, created_at timestamp, updated_at timestamp",
    "documents": "id string, user_id string, project_id string, file_url string, file_name string, file_path string, file_type string, file_size long, upload_time timestamp, status string, title string, authors string, abstract string, extracted_content string, full_content string, publication_date date",
    "document_chunks": "id string, document_id string, project_id string, chunk_text string, chunk_index int, embedding array<float>, created_at timestamp",
    "summaries": "id string, user_id string, document_id string, summary_text string, summary_type string, original_text string, created_at timestamp",
    "chat_history": f"id string, user_id string, project_id string, thread_id string, role string, content string, citations array<{CITATION}>, chunks_retrieved int, fact_check {FACT_CHECK}, created_at timestamp",
    "notes": "id string, user_id string, document_id string, title string, content string, created_at timestamp, updated_at timestamp",
    "articles": "id long, title string, author string, abstract string, content string, url string, category string",
}

STATUSES = ("uploaded", "processing", "indexed", "failed")
#: Another service writes `completed` where the canonical status is `indexed`.
STATUS_ALIASES = {"completed": "indexed"}
ROLES = ("user", "assistant", "system")
