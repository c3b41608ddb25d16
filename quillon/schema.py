"""Tables of a media catalogue and constants that are part of its semantics."""

from __future__ import annotations

RECORDS = (
    "id long, file_path string, file_hash string, file_mtime double, file_size long, thumbnail_path string, vector_id long, "
    "indexed_at timestamp, media_type string, frame_count int, duration_seconds double, page_number int, parent_document string"
)
FOLDERS = "id long, folder_path string, recursive boolean, added_at timestamp"
TOMBSTONES = "id long, vector_id long, deleted_at timestamp"
VECTORS = "vector_id long, embedding array<float>"
RESULTS = "file_path string, thumbnail_path string, score double, vector_id long, media_type string, parent_document string, rank int"
DEFAULTS = {"media_type": "image"}

# Sizes, limits and file kinds that results depend on.
TOP_K, MOST_K = 50, 500
IMAGES = ["jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif", "raw", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "pef", "raf", "heic", "heif"]
VIDEOS = ["mp4", "mkv", "avi", "mov", "webm", "wmv", "flv", "m4v"]
DOCUMENTS = ["pdf"]
THUMBNAIL_SIDE = 768
VIDEO_FPS, VIDEO_MOST_FRAMES, VIDEO_LEAST_FRAMES, FRAME_PIXELS = 2.0, 120, 4, 512 * 512
MOST_PAGES = 100
TRAINING_SAMPLE = 100_000
KINDS = {"images": ["image"], "videos": ["video"], "documents": ["document"], "media": ["image", "video"], "all": ["image", "video", "document"]}
INDEX_TYPES = {"flat": "flat", "ivf_flat": "ivf_flat", "ivf": "ivf_flat", "hnsw": "hnsw", "lsh": "hnsw", "ivf_pq": "ivf_pq", "pq": "ivf_pq", "graph": "graph"}
RERANK_INSTRUCTION = "Retrieve images relevant to the query."
SIDES = [128, 256, 384, 478, 512, 768, 1024, 1280, 1536]


def pixels(preset: str, default: int = 1024 * 1024) -> int:
    """Pixel budget of a square resolution preset, as in "512x512" with any remark behind; an unknown one has the default."""
    side = preset.split(" ")[0].partition("x")[0]
    return int(side) ** 2 if side.isdigit() and int(side) in SIDES and preset.startswith(f"{side}x{side}") else default
