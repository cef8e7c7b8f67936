"""Fixed limits of the evidence model, one place for all operators."""

SNAPSHOT_MAX_BYTES = 5 * 1024 * 1024
SNAPSHOT_MAX_NODES = 50_000
SNAPSHOT_MAX_DEPTH = 128
READABLE_MIN_CHARS = 80
CHUNK_BYTES = 256 * 1024
TTL_DAYS = 7
SESSION_QUOTA_BYTES = 250 * 1024 * 1024
GLOBAL_QUOTA_BYTES = 1024 * 1024 * 1024
PROJECTION_PAGES, PROJECTION_BLOCKS, PROJECTION_BYTES = 20, 600, 512 * 1024
TOKEN_CAP, TOKEN_RESERVE = 32_000, 8_000
MIN_BLOCK_CHARS = 20
MAX_GAPS = 64
TOPIC_UNITS = 200
UNIT_THRESHOLD, UNIT_MAX_DEPTH, UNIT_MAX_CANDIDATES, UNIT_MAX_UNITS = 0.6, 64, 1_000, 200
TITLE_MAX_CHARS = 512
DEBOUNCE_MS, MAX_WAIT_MS = 200, 2_000
QUEUE_LENGTH = 8


def token_limit(context: int) -> int:
    return min(TOKEN_CAP, context - TOKEN_RESERVE)
