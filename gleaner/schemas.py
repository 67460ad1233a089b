"""Explicit schemas of the stored relations, as DDL strings. Times are epoch milliseconds (UTC)."""

from __future__ import annotations

TABLES = {
    "pages": "url string, title string, description string, markdown string, cleaned_html string, http_status int, mime_type string, embedding array<float>, created_at_ms long, updated_at_ms long, version long",
    "image_linkages": "url string, hash string, is_active boolean, created_at_ms long",
    "cache": "kind string, key string, value string, updated_at_ms long",
    "entities": "entity_id string, name string, type string, canonical_name string, embedding array<float>",
    "entity_sources": "entity_id string, source_url string, facts array<string>, extracted_at_ms long",
    "edges": "from_id string, to_id string, relation_type string, source_url string, confidence float",
    "sessions": "session_id string, root_session_id string, user_id long, api_key_id long, query string, url string, mode string, answer string, finish_reason string, answer_found boolean, duration_ms long, created_at_ms long",
    "url_accesses": "access_id long, session_id string, url string, status string, reason string, is_used_in_answer boolean, accessed_at_ms long",
    "flow_events": "session_id string, event_type string, metadata string, created_at_ms long",
    "llm_usage": "session_id string, agent_name string, model_name string, prompt_tokens int, output_tokens int, total_tokens int, created_at_ms long",
    "api_usage": "session_id string, api_name string, call_count int, cost_usd double, created_at_ms long",
    "tasks": "task_id long, url string, kind string, status string, attempts int, max_attempts int, claimed_at_ms long, updated_at_ms long",
    "jobs": "job_id long, user_id long, base_url string, state string, completed_at_ms long",
    "url_states": "state_id long, job_id long, url string, stage string, error string",
    "index_configs": "config_id long, url string, period string, enabled boolean, last_run_ms long",
    "subscriptions": "subscription_id long, user_id long, tier string, status string, max_searches int, rollover_searches int, used_searches int, expires_at_ms long",
    "api_keys": "key_id long, user_id long, name string, deleted_at_ms long",
    "proxy_rules": "rule_id long, user_id long, pattern string, proxy string",
    "boxes": "container_id string, element_id string, path string, text string, left double, top double, right double, bottom double",
}

#: The allowed values of discriminator columns.
ENTITY_TYPES = ("ORGANIZATION", "PERSON", "PRODUCT", "FEATURE", "PRICING_TIER", "PRICE", "TECHNOLOGY", "LOCATION", "EVENT", "OTHER")
JOB_STATES_ENDED = ("COMPLETED", "FAILED", "CANCELLED")
TASK_STATES = ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED")
#: Days of an indexing period; 0 runs once.
PERIOD_DAYS = {"ONCE": 0, "DAILY": 1, "WEEKLY": 7, "MONTHLY": 30}
