"""Schemas of the engine's relations, as DDL strings."""

BLOCKS = "doc_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, n_lines int, is_list boolean, chars int"
PAGES = "doc_id string, page int, width double, height double, image_coverage double, biggest_image double"
TABLES = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"
ELEMENTS = "doc_id string, pos int, kind string, text string, page int, page_end int, level int, size double, rows array<array<string>>, caption string, at_page_top boolean"
CHUNKS = "chunk_id string, session_id string, seq int, section_id int, chunk_type string, page_start int, page_end int, breadcrumb string, text string"
SESSIONS = "session_id string, user_id string, doc_name string, pages int, chunks int, created_at timestamp, updated_at timestamp"
SOURCE = "struct<page:int,page_end:int,section:string,type:string,excerpt:string>"
MESSAGES = f"sequence long, id string, session_id string, role string, content string, sources array<{SOURCE}>, elapsed double, created_at timestamp"
USERS = "id string, name string, email string, password_hash string, created_at timestamp"
AUTH_SESSIONS = "token_hash string, user_id string, expires_at timestamp"
AUTH_ATTEMPTS = "client_key string, attempts int, window_start timestamp"
OCR_USAGE = "day date, requests int"
OCR_RESPONSE = "struct<pages:array<struct<page:int,markdown:string>>>"
OCR_PAGES = "array<struct<page:int,markdown:string>>"
