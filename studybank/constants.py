"""Fixed values.

Everything in this module must equal the published labelling / sectioning
conventions for results to agree: label categories, label codes, section-name
spellings and their canonical names, the alternation that marks a study-wide
("findings") header, the per-study overrides, the unmention prefixes and the
image normalisation constants.  They are stated here as plain data, in their
natural order, and nowhere else in the package.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: label categories (order is the column order of a label vector)
# ---------------------------------------------------------------------------
CATEGORIES = [
    "No Finding",
    "Enlarged Cardiomediastinum",
    "Cardiomegaly",
    "Lung Lesion",
    "Lung Opacity",
    "Edema",
    "Consolidation",
    "Pneumonia",
    "Atelectasis",
    "Pneumothorax",
    "Pleural Effusion",
    "Pleural Other",
    "Fracture",
    "Support Devices",
]

# FIXED VALUES: label codes
POSITIVE = 1
NEGATIVE = 0
UNCERTAIN = -1

# FIXED VALUES: categories with special rules
NO_FINDING = "No Finding"
SUPPORT_DEVICES = "Support Devices"
CARDIOMEGALY = "Cardiomegaly"
ENLARGED_CARDIOMEDIASTINUM = "Enlarged Cardiomediastinum"
# mention texts that also imply an uncertain Cardiomegaly label
HEART_FAILURE_TEXTS = ["chf", "heart failure"]

# FIXED VALUES: unmention phrase parts for the two cardiac observations
UNMENTION_PREFIXES = ["over the", "overly the", "in the"]
UNMENTION_QUALIFIERS = ["", " superior", " left", " right"]
# Cardiomegaly mentions that get no positional unmention
UNMENTION_SKIP = ["cardiomegaly", "cardiac enlargement"]

# ---------------------------------------------------------------------------
# FIXED VALUES: section headers
# ---------------------------------------------------------------------------
# header line: newline, one space, an upper-case name, a colon, one blank
SECTION_HEADER = r"\n ([A-Z ()/,-]+):\s"

# spelling -> canonical section name (58 entries)
SECTION_NAME_MAP = {
    "preamble": "preamble",
    "impression": "impression",
    "comparison": "comparison",
    "indication": "indication",
    "findings": "findings",
    "examination": "examination",
    "technique": "technique",
    "history": "history",
    "comparisons": "comparison",
    "clinical history": "history",
    "reason for examination": "indication",
    "notification": "notification",
    "reason for exam": "indication",
    "clinical information": "history",
    "exam": "examination",
    "clinical indication": "indication",
    "conclusion": "impression",
    "chest, two views": "findings",
    "recommendation(s)": "recommendations",
    "type of examination": "examination",
    "reference exam": "comparison",
    "patient history": "history",
    "addendum": "addendum",
    "comparison exam": "comparison",
    "date": "date",
    "comment": "comment",
    "findings and impression": "impression",
    "wet read": "wet read",
    "comparison film": "comparison",
    "recommendations": "recommendations",
    "findings/impression": "impression",
    "pfi": "history",
    "recommendation": "recommendations",
    "wetread": "wet read",
    "ndication": "impression",
    "impresson": "impression",
    "imprression": "impression",
    "imoression": "impression",
    "impressoin": "impression",
    "imprssion": "impression",
    "impresion": "impression",
    "imperssion": "impression",
    "mpression": "impression",
    "impession": "impression",
    "findings/ impression": "impression",
    "finding": "findings",
    "findins": "findings",
    "findindgs": "findings",
    "findgings": "findings",
    "findngs": "findings",
    "findnings": "findings",
    "finidngs": "findings",
    "idication": "indication",
    "reference findings": "findings",
    "comparision": "comparison",
    "comparsion": "comparison",
    "comparrison": "comparison",
    "comparisions": "comparison",
}

# main names: a header containing one of these (first in this order) takes it
MAIN_SECTIONS = ["impression", "findings", "history", "comparison", "addendum"]

# a header containing any of these describes the whole study -> "findings"
STUDY_WIDE_TERMS = [
    "chest",
    "portable",
    "pa and lateral",
    "lateral and pa",
    "ap and lateral",
    "lateral and ap",
    "frontal and",
    "two views",
    "frontal view",
    "pa view",
    "ap view",
    "one view",
    "lateral view",
    "bone window",
    "frontal upright",
    "frontal semi-upright",
    "ribs",
    "pa and lat",
]

# sections that hold the report body, in pick priority
SECTION_PRIORITY = ["impression", "findings", "last_paragraph", "comparison"]
# body sections that are dropped when empty
BODY_SECTIONS = ["impression", "findings"]
# separator that starts the last paragraph of a header-less tail
PARAGRAPH_BREAK = "\n \n"

# FIXED VALUES: per-study section-name overrides (study -> section to keep)
OVERRIDE_SECTION_NAMES = {
    "s50913680": "recommendations",
    "s59363654": "examination",
    "s59279892": "technique",
    "s59768032": "recommendations",
    "s57936451": "indication",
    "s50058765": "indication",
    "s53356173": "examination",
    "s53202765": "technique",
    "s50808053": "technique",
    "s51966317": "indication",
    "s50743547": "examination",
    "s56451190": "note",
    "s59067458": "recommendations",
    "s59215320": "examination",
    "s55124749": "indication",
    "s54365831": "indication",
    "s59087630": "recommendations",
    "s58157373": "recommendations",
    "s56482935": "recommendations",
    "s58375018": "recommendations",
    "s54654948": "indication",
    "s55157853": "examination",
    "s51491012": "history",
}

# FIXED VALUES: per-study character slices (study -> [start, end))
OVERRIDE_SLICES = {
    "s50525523": [201, 349],
    "s57564132": [233, 554],
    "s59982525": [313, 717],
    "s53488209": [149, 475],
    "s54875119": [234, 988],
    "s50196495": [59, 399],
    "s56579911": [59, 218],
    "s52648681": [292, 631],
    "s59889364": [172, 453],
    "s53514462": [73, 377],
    "s59505494": [59, 450],
    "s53182247": [59, 412],
    "s51410602": [47, 320],
    "s56412866": [522, 822],
    "s54986978": [59, 306],
    "s59003148": [262, 505],
    "s57150433": [61, 394],
    "s56760320": [219, 457],
    "s59562049": [158, 348],
    "s52674888": [145, 296],
    "s55258338": [192, 568],
    "s59330497": [140, 655],
    "s52119491": [179, 454],
    "s58235663": [0, 0],
    "s50798377": [0, 0],
    "s54168089": [0, 0],
    "s53071062": [0, 0],
    "s56724958": [0, 0],
    "s54231141": [0, 0],
    "s53607029": [0, 0],
    "s52035334": [0, 0],
}

# ---------------------------------------------------------------------------
# FIXED VALUES: text / model conventions
# ---------------------------------------------------------------------------
CAPTION_TEMPLATE = "this is a photo of %s."
MAX_TOKENS = 128
SENTENCE_JOIN = ". "
CONTRASTIVE_INIT_TEMPERATURE = 0.07
SINKHORN_EPSILON = 0.05
SINKHORN_ROUNDS = 3
RESIZE_SHORTER_SIDE = 256
CROP_SIZE = 224
CROP_SCALE = (0.75, 1.0)
IMAGE_MEAN = [0.485, 0.456, 0.406]
IMAGE_STD = [0.229, 0.224, 0.225]
LOGIT_SCALE_CLAMP = 100.0

# retrieval defaults
DEFAULT_K = 2
DEFAULT_MAX_K = 10
DEFAULT_TEST_SIZE = 50
