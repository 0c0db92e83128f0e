"""Table layouts and value sets. (source_path, msg_index) is the order of messages everywhere."""

from __future__ import annotations

MESSAGE = "source_path string, msg_index int, chat_name string, sender string, time string, content string, type string"
RESPONSE = "run_id string, task_pos int, step_id string, chat_name string, chunk_index int, chunk_total int, kind string, completed boolean, response_text string"
CHATROW = "scan_id string, row_pos int, name string, badge_text string, is_group boolean, selected boolean, y int"
OCRLINE = "image_id string, line_pos int, text string, x1 int, y1 int, x2 int, y2 int, conf double"
RUN = "ok boolean, finished_at_utc string, config_path string, output_dir string, message_json_paths array<string>, report_generated boolean, error string"

# The two type vocabularies.
STORED_TYPES = ["text", "system", "link_card", "image", "file", "recalled", "unsupported"]
CLEAN_TYPES = ["text", "system", "link_card", "image", "other", "unsupported", "call", "video", "voice"]
