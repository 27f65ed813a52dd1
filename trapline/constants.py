"""Constants of the detections domain.

Everything under "Fixed values" must equal the behaviour being reproduced:
labels, file-name rules, report captions and the seed name dictionary.
They are kept together, in their natural order, and are not derived.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Image file extensions accepted by the listing (compared lower-case).
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")

# Taxonomic class -> display category.
CATEGORY_MAP = {
    "aves": "bird",
    "mammalia": "mammal",
    "reptilia": "reptile",
    "amphibia": "amphibian",
    "actinopterygii": "fish",
    "insecta": "insect",
}

# Model labels that mean "nothing detected" (compared trimmed and lower-case).
NO_DETECTION_LABELS = ("blank", "no cv result", "no_cv_result")

# Category assigned to a detection whose taxonomy is all "nothing detected".
NO_DETECTION_CATEGORY = "no_detection"
UNKNOWN_CATEGORY = "unknown"
UNKNOWN_SCIENTIFIC_NAME = "Unknown"

# Detections table columns, in file order.
DETECTION_COLUMNS = (
    "image_path", "image_name", "image_date",
    "species", "scientific_name", "confidence",
    "category", "common_name", "japanese_name", "timestamp",
)

# Pivot report captions.
PIVOT_HEADER_LABEL = "日付"
PIVOT_TOTAL_IMAGES_LABEL = "合計撮影枚数"
PIVOT_NO_DETECTION_LABEL = "撮影無し"
PIVOT_TOTAL_LABEL = "合計"
UNKNOWN_DATE = "unknown-date"

# Routing folder names and limits.
NO_DETECTION_FOLDER = "未検出_No_Detection"
UNKNOWN_SPECIES_FOLDER = "Unknown_Species"
FOLDER_INVALID_CHARS = '<>:"/\\|?*'
FOLDER_NAME_MAX = 100
LONG_PATH_THRESHOLD = 240
SHORT_FOLDER_PREFIX = 40
SHORT_FOLDER_DIGEST = 8
DUPLICATE_SUFFIX_DIGITS = 3
DUPLICATE_SUFFIX_MAX = 9999

# Confidence bands: (caption, inclusive lower bound), highest first.
CONFIDENCE_BANDS = (
    ("0.9-1.0 (非常に高い)", 0.9),
    ("0.7-0.9 (高い)", 0.7),
    ("0.5-0.7 (中程度)", 0.5),
    ("0.3-0.5 (低い)", 0.3),
    ("0.0-0.3 (非常に低い)", None),
)

# Summary report captions.
SUMMARY_TITLE = "Wildlife Detection Summary Report"
SUMMARY_SECONDS = "処理時間 (秒)"
SUMMARY_RATE = "処理速度 (画像/秒)"
SUMMARY_BASIC_HEADER = ("項目", "値")
SUMMARY_SPECIES_HEADER = ("種名", "検出回数", "割合 (%)")
SUMMARY_CATEGORY_HEADER = ("カテゴリ", "検出回数", "割合 (%)")
SUMMARY_CONFIDENCE_HEADER = ("信頼度範囲", "検出数")
SUMMARY_BASIC_SECTION = "基本統計"
SUMMARY_TOTAL_IMAGES = "総画像数"
SUMMARY_DETECTED_IMAGES = "検出成功画像数"
SUMMARY_UNDETECTED_IMAGES = "検出失敗画像数"
SUMMARY_TOTAL_DETECTIONS = "総検出数"
SUMMARY_SUCCESS_RATE = "成功率 (%)"
SUMMARY_SPECIES_SECTION = "検出種別統計"
SUMMARY_CATEGORY_SECTION = "カテゴリ別統計"
SUMMARY_CONFIDENCE_SECTION = "信頼度統計"

# Wide detail export: header and remarks.
DETAIL_HEADER = (
    "画像ファイル名", "画像パス", "検出日時", "検出数",
    "種名_1", "一般名_1", "和名_1", "学名_1", "信頼度_1", "カテゴリ_1",
    "種名_2", "一般名_2", "和名_2", "学名_2", "信頼度_2", "カテゴリ_2",
    "種名_3", "一般名_3", "和名_3", "学名_3", "信頼度_3", "カテゴリ_3",
    "備考",
)
DETAIL_REMARK_NONE = "野生生物が検出されませんでした"
DETAIL_REMARK_MORE = "追加で{n}個の検出があります"

# Species list export header.
SPECIES_LIST_HEADER = ("種名", "一般名", "和名", "学名", "カテゴリ", "検出回数", "最高信頼度", "平均信頼度")

# Result pages.
RESULTS_PER_PAGE = 100
RESULT_PAGE_EMPTY_SPECIES = "検出なし"

# EXIF tag ids.
EXIF_IFD_POINTER = 0x8769
EXIF_TAG_DATETIME_ORIGINAL = 36867
EXIF_TAG_DATETIME_DIGITIZED = 36868
EXIF_TAG_DATETIME = 306

# Job defaults.
DEFAULT_CONFIDENCE_THRESHOLD = 0.1
DEFAULT_CHUNK_SIZE = 500
DEFAULT_MODEL_BATCH_SIZE = 32
DEFAULT_CONSECUTIVE_ERROR_LIMIT = 3
DEFAULT_COUNTRY = "JPN"

# Seed vernacular-name dictionary: category, species and genus maps.
SEED_NAMES = {
    "category": {
        "bird": "鳥類",
        "mammal": "哺乳類",
        "reptile": "爬虫類",
        "amphibian": "両生類",
        "fish": "魚類",
        "insect": "昆虫類",
        "no_detection": "未検出",
        "unknown": "不明",
    },
    "species": {
        "Corvus macrorhynchos": "ハシブトガラス",
        "Corvus corone": "ハシボソガラス",
        "Passer montanus": "スズメ",
        "Passer domesticus": "イエスズメ",
        "Hirundo rustica": "ツバメ",
        "Streptopelia orientalis": "キジバト",
        "Columba livia": "カワラバト",
        "Pycnonotus sinensis": "シロガシラ",
        "Hypsipetes amaurotis": "ヒヨドリ",
        "Turdus pallidus": "シロハラ",
        "Turdus naumanni": "ツグミ",
        "Parus major": "シジュウカラ",
        "Parus minor": "シジュウカラ",
        "Aegithalos caudatus": "エナガ",
        "Zosterops japonicus": "メジロ",
        "Bubo virginianus": "アメリカワシミミズク",
        "Procyon lotor": "アライグマ",
        "Nyctereutes procyonoides": "タヌキ",
        "Vulpes vulpes": "アカギツネ",
        "Sus scrofa": "イノシシ",
        "Cervus nippon": "ニホンジカ",
        "Macaca fuscata": "ニホンザル",
        "Lepus brachyurus": "ニホンノウサギ",
        "Mustela itatsi": "ニホンイタチ",
        "Martes melampus": "ニホンテン",
        "Meles anakuma": "ニホンアナグマ",
        "Paguma larvata": "ハクビシン",
        "Felis catus": "イエネコ",
        "Canis lupus": "オオカミ",
        "Canis familiaris": "イヌ",
        "Ursus thibetanus": "ツキノワグマ",
        "Capreolus pygargus": "ノロジカ",
        "Rattus norvegicus": "ドブネズミ",
        "Apodemus speciosus": "アカネズミ",
        "Petaurista leucogenys": "ムササビ",
        "Sciurus lis": "ニホンリス",
        "Pteromys momonga": "ニホンモモンガ",
        "Elaphe climacophora": "アオダイショウ",
        "Rhabdophis tigrinus": "ヤマカガシ",
        "Trypoxylus dichotomus": "カブトムシ",
    },
    "genus": {
        "Corvus": "カラス属",
        "Passer": "スズメ属",
        "Turdus": "ツグミ属",
        "Parus": "シジュウカラ属",
        "Procyon": "アライグマ属",
        "Vulpes": "キツネ属",
        "Cervus": "シカ属",
        "Macaca": "マカク属",
        "Felis": "ネコ属",
        "Canis": "イヌ属",
        "Ursus": "クマ属",
    },
}
