"""DDL of the tables that the operators read and write."""

LINK = "STRUCT<url: STRING, source: STRING, domain: STRING>"
ENTITY = "STRUCT<type: STRING, url: STRING>"

TABLES = {
    "messages": f"chat_id BIGINT, message_id BIGINT, user_id BIGINT, chat_type STRING, text STRING, caption STRING, entities ARRAY<{ENTITY}>, "
    f"caption_entities ARRAY<{ENTITY}>, preview_url STRING, sender_chat_id BIGINT, is_automatic_forward BOOLEAN, new_chat_members ARRAY<BIGINT>, update_type STRING, created_at BIGINT",
    "user_reputation": "chat_id BIGINT, user_id BIGINT, reputation_score DOUBLE, first_seen_at BIGINT, last_seen_at BIGINT, messages_seen BIGINT, spam_confirmed BIGINT, ham_confirmed BIGINT",
    "user_profiles": "user_id BIGINT, username STRING, first_name STRING, last_name STRING, language_code STRING, is_bot BOOLEAN, is_premium BOOLEAN, bio STRING, bio_fetched_at BIGINT, updated_at BIGINT",
    "allowed_chats": "chat_id BIGINT, title STRING, added_by_user_id BIGINT, added_at BIGINT",
    "whitelisted_users": "user_id BIGINT, note STRING, added_by_user_id BIGINT, added_at BIGINT",
    "fingerprints": "id BIGINT, fingerprint_type STRING, value STRING, weight DOUBLE, hit_count BIGINT, false_positive_count BIGINT, source STRING, last_hit_at BIGINT, created_at BIGINT",
    "vote_sessions": "id BIGINT, chat_id BIGINT, original_message_id BIGINT, vote_message_id BIGINT, suspect_user_id BIGINT, skeleton_hash STRING, content_hash STRING, "
    "status STRING, spam_votes BIGINT, ham_votes BIGINT, reason STRING, created_at BIGINT, expires_at BIGINT, closed_at BIGINT",
    "votes": "session_id BIGINT, voter_user_id BIGINT, vote STRING, ts BIGINT, seq BIGINT",
    "action_log": "id BIGINT, chat_id BIGINT, message_id BIGINT, user_id BIGINT, action STRING, reason STRING, confidence DOUBLE, metadata_json STRING, created_at BIGINT",
    "admin_notifications": "id BIGINT, vote_session_id BIGINT, action_log_id BIGINT, notify_user_id BIGINT, message_id BIGINT, base_text STRING, created_at BIGINT, updated_at BIGINT",
    "message_observations": "id BIGINT, chat_id BIGINT, message_id BIGINT, user_id BIGINT, skeleton_hash STRING, content_hash STRING, simhash STRING, link_domains_json STRING, created_at BIGINT",
    "verdicts": "chat_id BIGINT, message_id BIGINT, status STRING, is_spam BOOLEAN, confidence DOUBLE, category STRING, signal_phrases ARRAY<STRING>",
    "og": "url STRING, title STRING, description STRING, site_name STRING, image_alt STRING, text STRING, truncated BOOLEAN",
}
