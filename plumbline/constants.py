"""Values that results depend on."""

# ---- fixed values ----
#: Unit prefix of a recognised code, removed once: one of X Y, a small letter, a digit.
CODE_PREFIX = r"^[XY][a-z][0-9]\s*"
CODE_CHARS = r"A-Za-z0-9+\-./_ \[\]"
CODE_MIN, CODE_MAX = 2, 50
#: Look-alike characters, each to its twin.
LOOKALIKE_FROM = "0O1I5S8B6G2Z7T4A"
LOOKALIKE_TO = "O0I1S5B8B6Z2T7A4"
MATCH_MAX_DISTANCE, MATCH_MIN_LENGTH, MATCH_TOP = 3, 4, 3
LABEL_PLACEHOLDER = "xxxxxxxxxx"
LABEL_HEADERS = ("製品番号", "code")
UNSYNCED = ("PENDING", "FAILED", "SYNCING")
ELIGIBLE = ("PENDING", "FAILED")
MAX_RETRIES = 3
REFRESH_MS = 24 * 60 * 60 * 1000
IDLE_HOURS = 3
FRAME_GAP_MS = 150
BACKOFF_MIN_MS, BACKOFF_MAX_MS = 10_000, 5 * 60 * 60 * 1000
NO_VALUE = "—"
UNSET = "未指定"
CONFIDENCE_GREEN, CONFIDENCE_AMBER = 0.6, 0.3
RECOGNISED_CONFIDENCE, RECOGNISED_RATIO, RECOGNISED_USEFUL = 0.62, 0.75, 4
KEEP_RATIO, KEEP_SHORT, KEEP_SHORT_CONFIDENCE = 0.45, 2, 0.60
ERROR_TOKENS = ("EMPTY", "FORMATERR", "ERROR")
SCORE_CONFIDENCE, SCORE_RATIO, SCORE_LENGTH, SCORE_LENGTH_MAX = 0.80, 0.15, 0.002, 24
HEAT_THRESHOLD, HEAT_MIN_SIZE, AREA_MIN, UNCLIP = 0.18, 15, 120.0, 1.5
DETECT_SIDE, RECOGNISE_HEIGHT, RECOGNISE_MIN, RECOGNISE_MAX, RECOGNISE_STEP = 512, 48, 32, 1920, 32
IMAGE_SIDE = 1600
CONTRAST_MIN_RANGE, CONTRAST_SPAN, CONTRAST_MAX_SCALE, CONTRAST_LIFT = 12.0, 220.0, 2.2, 8.0
BLUR_BELOW, TILT_LOW, TILT_HIGH = 100.0, 15.0, 75.0
LUMINANCE = (0.299, 0.587, 0.114)
MERGE_HEIGHT_RATIO, MERGE_OVERLAP, MERGE_CENTER, MERGE_WIDTH_OVERLAP = 2.0, 0.45, 0.55, 0.35
MERGE_GAP_HEIGHT, MERGE_GAP_IMAGE, MERGE_UNION_HEIGHT, MERGE_PADDING = 1.8, 0.04, 1.45, 1.0
EXPAND_X, EXPAND_Y, MAX_REGIONS, TALL = 1.10, 1.30, 24, 1.2
BLUR_WIDTH, CROP_MIN, CROP_CHECK, WHITE = 320, 8, 128, 255
CROP_BRIGHT, CROP_DARK, CROP_EDGE, CROP_SATURATION, CROP_VALUE = 175.0, 80.0, 110.0, 0.18, 0.16
CROP_BRIGHT_SHARE, CROP_FEW, CROP_EDGE_SHARE, CROP_FLAT, CROP_PLAIN = 0.96, 0.002, 0.003, 35.0, 45.0
CROP_COLORED_LEAST, CROP_EDGE_LEAST = 2, 3
COLOR_SAMPLES, COLOR_SHARE = 64, 0.01
COLORS = ("RED", "YELLOW", "GREEN", "CYAN", "BLUE", "WHITE", "BLACK", "UNKNOWN")
DEFAULT_LABELS = ("H150X150X7", "B1Sb30N-7A", "C200X200X8")
DEFAULT_CONSTRUCTIONS = ((1, "F-M_FQ", "20251111202F"), (2, "新社屋建設工事", "20250001"))
SEED_CONSTRUCTIONS = ((1, "○○ビル新築工事", "CONST-001"), (2, "△△マンション改修工事", "CONST-002"), (3, "□□工場増築工事", "CONST-003"))
SEED_PROCESSES = (
    (1, 1, "柱加工", "PROC-001"), (2, 1, "梁加工", "PROC-002"), (3, 1, "検査", "PROC-003"), (4, 1, "出荷", "PROC-004"), (5, 2, "搬入", "PROC-005"),
    (6, 2, "組立", "PROC-006"), (7, 2, "溶接", "PROC-007"), (8, 3, "切断", "PROC-008"), (9, 3, "塗装", "PROC-009"),
)
DEFAULT_PROCESSES = (
    (1, 1, "FINS", "FINS"), (2, 1, "FAS検査", "FAS"), (3, 1, "FAILA0", "FAIL"), (4, 1, "FAW検査", "FAW"), (5, 1, "CINJA0", "CINJ"), (6, 1, "建て方管理", "BLD"),
    (7, 2, "一次加工", "P01"), (8, 2, "組立", "P02"), (9, 2, "溶接", "P03"), (10, 2, "塗装", "P04"), (11, 2, "検査", "P05"),
    (12, 3, "FINS", "FINS"), (13, 3, "FAS検査", "FAS"), (14, 3, "FAILA0", "FAIL"), (15, 3, "FAW検査", "FAW"), (16, 3, "CINJA0", "CINJ"), (17, 3, "建て方管理", "BLD"),
)
# ---- end of fixed values ----
#: How long a consumer of frames may be silent before it counts as done; our own choice.
BUSY_MS = 60_000
