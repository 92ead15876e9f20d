"""They have to be exactly these for results to be right.

Label names and codes, quiz column names, text patterns, boilerplate, model
names and defaults are all part of the data formats this package reads.
"""

# Ordinal classes; the position is the class code.
LABEL_NAMES = ("incorrect", "partial", "correct")
CLASS_CODES = (0, 1, 2)

# Names accepted by the lenient normaliser.
LENIENT_LABELS = {
    "incorrect": 0,
    "partial": 1,
    "partially correct": 1,
    "correct": 2,
}

# Five-way corpus labels and the three-way class each belongs to.
FIVE_WAY_LABELS = {
    "correct": 2,
    "partially_correct_incomplete": 1,
    "contradictory": 0,
    "irrelevant": 0,
    "non_domain": 0,
}
FIVE_WAY_TOPIC = "scientsbank"

# Display names on a plotted confusion matrix.
DISPLAY_LABELS = ("Incorrect", "Partially Correct", "Correct")

# Points per quiz subtask and the class code they stand for.
POINT_LABELS = {0.0: 0, 0.5: 1, 1.0: 2}

# Splits, with the share of each topic that goes to val and to test.
SPLITS = ("train", "val", "test")
TRAIN_SHARE = 0.6
HELD_OUT_SHARE = 0.2

# Quiz sections and the subtask letters of each.
QUIZ_LETTERS = {
    "sentences": ("a", "b", "c", "d", "e", "f"),
    "validity_and_soundness": ("a", "b", "c", "d", "e", "f", "g", "h"),
}
QUIZ_TOPICS = {
    "sentences_": "sentences",
    "validity_and_soundness_": "validity",
}

# Column names of the quiz export, and the remark task numbers.
QUIZ_PARTICIPANT = "Teilnehmer"
QUIZ_TOTAL = "Summe"
QUIZ_COLUMNS = {
    "1. Sentences": "sentences",
    "3. Validity and Soundness (II)": "validity_and_soundness",
}
QUIZ_UNUSED_COLUMNS = ("2. Validity and Soundness (I)", "4. Arguments")
REMARK_TASKS = {0: "sentences", 2: "validity_and_soundness"}

# Quiz groups: the name prefix, and the numbers that are kept.
GROUP_PREFIX = "Quiz Group "
GROUP_NUMBER = r"Quiz Group (\d+)"
GROUP_KEEP_BELOW = 3
GROUP_KEEP_FROM = 10
GROUP_KEEP_UNTIL = 27

# Styled spans to drop, in this order.
SPAN_PATTERNS = (
    r'<span style="[^"]*background-color:rgb\(\d{1,3},\d{1,3},\d{1,3}\);?[^"]*">',
    r'<span style="?background-color:transparent;color:#000000;"?>',
    r'<span style="?color:rgb\(0,0,0\);"?>',
)
HTML_MARKER = "<!--HTML-->"
PARAGRAPH_BREAK = "</p><p>"
LINE_BREAK = "<br />"
SPAN_END = "</span>"
LINE_BREAK_PATTERN = r"<br\s*/?>"
TRAILING_PARAGRAPH = r"\s*</?p>\s*$"
TRAILING_LINE_BREAK = r"\s*<br\s*/?>\s*$"

# Boilerplate that opens a student answer.
BOILERPLATE = (
    r"True/False,\s*because\s*\.\.\.\s*<br\s*/?>",
    r"Yes/No,\s*because\s*\.\.\.\s*<br\s*/?>",
)

# Prompt parts.
PROMPT_QUESTION = "Question: "
PROMPT_ANSWER = "Answer: "
PROMPT_REFERENCE = "Reference answer: "

# Which generators see the reference answer by default.
PASS_REFERENCE = {"correct": True, "partial": True, "incorrect": False}
GENERATION_ORDER = ("correct", "partial", "incorrect")

# Run names, model groups, display names and display order of known models.
GPT_RUN_PREFIX = "gpt-4o"
GPT_GROUP = "openai/chatgpt-4o"
RUN_GROUPS = {
    "lora_Llama-3.2-1B-Instruct": "meta-llama/llama-3.2-1b-instruct",
    "lora_Qwen3-0.6B": "qwen/qwen3-0.6b",
    "lora_gpt2-large": "openai-community/gpt2-large",
    "lora_flan-t5-large": "google/flan-t5-large",
}
MODEL_DISPLAY = {
    "openai/chatgpt-4o": "GPT-4o",
    "meta-llama/llama-3.2-1b-instruct": "Llama 3.2 1B Instruct",
    "qwen/qwen3-0.6b": "Qwen3 0.6B",
    "openai-community/gpt2-large": "GPT-2 Large",
    "google/flan-t5-large": "Flan-T5 Large",
}
MODEL_ORDER = {
    "openai/chatgpt-4o": 1,
    "meta-llama/llama-3.2-1b-instruct": 2,
    "google/flan-t5-large": 3,
    "openai-community/gpt2-large": 4,
    "qwen/qwen3-0.6b": 5,
}
UNKNOWN_MODEL_ORDER = 999

# Point sums may differ from recorded totals by this much.
POINTS_TOLERANCE = 0.01

# Default seeds.
SEED = 42
