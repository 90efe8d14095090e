"""Fixed values.  Results depend on these being exactly as they are."""

VIDEO_SUFFIXES = [
    "mp4", "mov", "mxf", "avi", "mkv", "m4v", "webm", "mts", "m2ts", "ts", "vob", "mpg", "mpeg", "wmv", "flv",
    "braw", "r3d", "ari",
]
IMAGE_SUFFIXES = [
    "jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "tiff", "tif", "bmp",
    "arw", "cr2", "cr3", "nef", "dng", "raf", "orf", "rw2", "pef", "srw", "x3f",
]
AUDIO_SUFFIXES = ["wav", "mp3", "aac", "m4a", "flac", "ogg", "aiff", "wma", "opus", "ape", "wv"]

# Upper pixel counts of the resolution buckets.
RESOLUTION_BUCKETS = [
    (921600, "720p"), (2073600, "1080p"), (3686400, "1440p"), (8294400, "4k"), (14745600, "5k"),
]
PIXELS_1080P, PIXELS_4K, PIXELS_5K = 1920 * 1080, 3840 * 2160, 5120 * 2880

LOG_TRANSFERS = [
    "arib-std-b67", "smpte2084", "smpte428", "log", "slog", "slog2", "slog3", "vlog", "clog", "clog2", "clog3",
    "dlog", "dlog-m", "hlg", "n-log", "f-log", "f-log2", "blackmagic", "arri", "logc", "redlogfilm",
]
LOG_WORDS = ["log", "hlg", "pq", "hdr", "dci-p3"]

SPEECH_ENERGY = {0: 150.0, 1: 250.0, 2: 350.0, 3: 500.0}
SPEECH_ZCR = (0.05, 0.5)
SPEECH_FRAME_MS = 30

# Seconds per unit when there is no history.
DEFAULT_RATES = {
    "metadata": 1.0, "telemetry": 0.5, "vad": 0.5, "motion": 0.5, "scenes": 0.3, "frame_decode": 0.05,
    "objects": 0.3, "faces": 0.2, "ocr": 0.3, "clip": 0.15, "visual": 5.0, "transcript": 3.0,
}
STAGE_ORDER = ["metadata", "telemetry", "vad", "visual_processing", "visual", "transcript"]
VISUAL_PARTS = ["motion", "scenes", "frame_decode", "objects", "faces", "ocr", "clip"]
STATUS_ORDER = [
    "metadata", "telemetry", "vad", "motion", "scenes", "frame_decode", "objects", "faces", "ocr", "clip",
    "visual", "transcript",
]

SHOT_LABELS = {
    "aerial drone footage from above": "aerial",
    "interview with person talking to camera": "interview",
    "b-roll footage of scenery or environment": "b-roll",
    "studio footage with controlled lighting": "studio",
    "handheld camera footage": "handheld",
    "tripod static shot": "static",
    "phone footage vertical video": "phone",
    "dashcam footage from car": "dashcam",
    "security camera footage": "security",
    "news broadcast footage": "broadcast",
}

CONTEXT_LABELS = {
    "person": "Person identified",
    "location": "Location",
    "nearby_landmarks": "Nearby landmarks/POIs",
    "activity": "Activity",
    "language": "Language spoken",
    "device": "Filmed with",
    "topic": "Topic/Subject",
    "organization": "Organization",
    "event": "Event",
}
BATCH_CONTEXT_LABELS = {
    "person": "Person identified",
    "location": "Location",
    "nearby_landmarks": "Nearby landmarks/POIs",
    "activity": "Activity",
    "topic": "Activity/Subject",
    "language": "Language spoken",
    "device": "Filmed with",
}
