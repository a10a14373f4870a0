"""Fixed values that must equal the behaviour being reproduced.

They are stated plainly, in their natural order, and used as data by the
column expressions elsewhere.
"""

# ---------------------------------------------------------------- fixed values
# System message put first in every SFT sample.
SFT_SYSTEM_PROMPT = (
    "You are playing the role of a psychological therapist with a focus on Cognitive "
    "Behavioral Therapy and Motivational Interviewing. Your role is to facilitate "
    "reflection, self-awareness, and behavioral change while respecting the user's autonomy.\n"
)

# Role normalisation (X1): exact names first, then substrings; anything else is user.
ROLE_EXACT_ASSISTANT = ["assistant", "bot", "agent", "counselor", "counsellor",
                        "therapist", "doctor", "practitioner"]
ROLE_EXACT_USER = ["client", "patient", "human", "user"]
ROLE_SUBSTR_USER = ["user", "human", "client", "patient"]
ROLE_SUBSTR_ASSISTANT = ["assistant", "bot", "agent", "therapist"]

# Key priority inside one dialogue item.
TEXT_KEYS = ["text", "utterance", "utterance_text", "message", "content"]
ROLE_KEYS = ["role", "speaker", "sender"]
# Text column priority for labelled CSV rows.
TEXT_COLUMNS = ["utterance_text", "utterance", "text", "message", "content"]

# Tokens that pandas.read_csv turns into missing values by default.
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                 "n/a", "nan", "null"]

# Text cleaning replacements before NFKD.
CLEAN_REPLACEMENTS = {"“": '"', "”": '"', "‘": "'", "’": "'",
                      "—": "-", "–": "-"}

# Characters Python's str.strip()/str.split() treat as whitespace.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
# Line boundaries used by str.splitlines().
PY_LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"

# Speaker labels of the transcript format.
TRANSCRIPT_SPEAKERS = {"assistant": "Clinician", "user": "Client"}
END_CHECK_SPEAKERS = {"user": "Patient", "assistant": "Doctor"}
END_CHECK_HEADER = "Here is the conversation you have to judge whether it has ended or not."
END_CHECK_TAIL = 6          # messages looked at by the end check (W4)
END_STREAK = 2              # consecutive "yes" verdicts that end a conversation (W6)
DOCTOR_INSIST = ""          # appended after "\n" at streak 1 (W7)

# Judge (evaluate folder): metric templates skipped by name, scale, token limit.
SKIPPED_TEMPLATES = ["panas_after.txt", "panas_before.txt"]
JUDGE_METRICS = ["CBT_1_guided_discovery", "CBT_2_focus", "CBT_3_strategy",
                 "general_1_understanding", "general_2_interpersonal_effectiveness",
                 "general_3_collaboration"]
JUDGE_MAX_NEW_TOKENS = 256

# Training context, default split and window sizes.
MAX_SEQ_LENGTH = 2048
TRAIN_FRAC = 0.90
SPLIT_SEED = 42
DEFAULT_WINDOWS = [1, 2, 5]
RESPONSE_MARKER = "<|im_start|>assistant"
IGNORE_INDEX = -100
EARLY_STOPPING_PATIENCE = 3
SAVE_TOTAL_LIMIT = 3

# Chat template pieces (ChatML).
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"

# Simulation grid: experiment folder, doctor model, expand_history.
EXPERIMENTS = [
    ("zero_shot_doctor_instructions", "qwen3", False),
    ("zero_shot_doctor_instructions_1", "qwen3", False),
    ("zero_shot_doctor_instructions_2", "qwen3", False),
    ("zero_shot_expand_2", "qwen3", True),
    ("one_shot", "qwen3", False),
    ("one_shot_expand", "qwen3", True),
    ("models_1e_annomi_sft_1", "models/models_1e/qwen-annomi-therapist_w1", True),
    ("models_1e_annomi_sft_5", "models/models_1e/qwen-annomi-therapist_w5", True),
    ("models_3e_annomi_sft_1", "models/models_3e/qwen-annomi-therapist_w1", True),
    ("models_3e_annomi_sft_5", "models/models_3e/qwen-annomi-therapist_w5", True),
    ("models_1e_cactus_sft_1", "models/models_1e/qwen-cactus-therapist_w1", True),
    ("models_1e_cactus_sft_5", "models/models_1e/qwen-cactus-therapist_w5", True),
    ("models_1e_cactus_sft_50", "models/models_1e/qwen-cactus-therapist_w50", True),
    ("models_3e_cactus_sft_5", "models/models_3e/qwen-cactus-therapist_w5", True),
]
NUM_PROFILE_REPEATS = 9
MAX_TURNS = 100

# Profile value validation (F8): exact values and substrings that blank a field.
PROFILE_BLANK_EXACT = ["", "not specified", "unknown", "n/a"]
PROFILE_BLANK_SUBSTR = ["cannot be identified", "cannot be determined", "not mention",
                        "not exhibited"]
PROFILE_HISTORY_START = "Patient History:"
PROFILE_HISTORY_END = "In the upcoming conversation"

# PANAS feelings, in the order the template lists them.
PANAS_FEELINGS = ["Interested", "Excited", "Strong", "Enthusiastic", "Proud", "Alert",
                  "Inspired", "Determined", "Attentive", "Active", "Distressed", "Upset",
                  "Guilty", "Scared", "Hostile", "Irritable", "Ashamed", "Nervous",
                  "Jittery", "Afraid"]
PANAS_POSITIVE = PANAS_FEELINGS[:10]
PANAS_NEGATIVE = PANAS_FEELINGS[10:]

# Chat-request validation messages (F10) and completion record.
REQ_INVALID_JSON = "Invalid JSON"
REQ_NO_MESSAGES = "No messages provided"
REQ_NOT_LIST = "Messages must be a list"
REQ_BAD_ITEM = "Invalid message format at index {i}"
COMPLETION_OBJECT = "chat.completion"
COMPLETION_FINISH = "stop"
# ---------------------------------------------------------------- end fixed values


def java_class(chars: str) -> str:
    """Render a set of characters as a Java regex character-class body."""
    out = []
    for ch in chars:
        cp = ord(ch)
        out.append(f"\\x{{{cp:x}}}" if cp > 0x7e or cp < 0x20 or ch in "\\]^-[" else ch)
    return "".join(out)


# Explicit classes (valid in Java and RE2 alike) — used by the SQL oracles.
WS_CLASS = "[" + java_class(PY_WHITESPACE) + "]"
NON_WS_CLASS = "[^" + java_class(PY_WHITESPACE) + "]"
# Compact Java forms of the same sets: with the (?U) flag Java's \s is the Unicode
# White_Space property, which plus \x1c-\x1f is exactly Python's whitespace.  One
# property test per char instead of a 30-way union: ~4x faster on long texts.
J_WS = "[\\s\\x{1c}-\\x{1f}]"
J_NON_WS = "[^\\s\\x{1c}-\\x{1f}]"
LINE_BREAK_RE = "\\r\\n|[" + java_class(PY_LINE_BREAKS) + "]"

# ---------------------------------------------------------------- fixed values (profiles)
# Patient profile template with its 13 slots, in order.
PROFILE_TEMPLATE = (
    "You will act as a help-seeker struggling with negative emotions in a conversation with "
    "someone who is listening to you.\n"
    "YOUR PROFILE:\n"
    "${name}${gender}${age}${marital_status}${occupation}${situation_of_the_client}"
    "${counseling_history}${resistance_toward_the_support}${symptom_severity}"
    "${cognition_distortion_exhibition}${depression_severity}${suicidal_ideation_severity}"
    "${homicidal_ideation_severity}\n"
    "YOUR TASK:\n"
    "As the client, your role is to continue the conversation by responding naturally to the "
    "supporter, reflecting the characteristics outlined in your profile."
)
PROFILE_SECTION_START = "YOUR PROFILE:"
PROFILE_SECTION_END = "YOUR TASK:"
# Profile fields: (source key, slot, label, lower-cased before use)
PROFILE_FIELDS = [
    ("name", "name", "name", True),
    ("gender", "gender", "gender", True),
    ("age", "age", "age", True),
    ("marital status", "marital_status", "marital status", True),
    ("occupation", "occupation", "occupation", True),
    ("situation of the client", "situation_of_the_client", "situation of the client", True),
    ("counseling history", "counseling_history", "counseling history", False),
    ("resistance toward the support", "resistance_toward_the_support", "resistance toward the support", True),
]
PROFILE_TAIL_FIELDS = [
    ("depression severity", "depression_severity", "depression severity"),
    ("suicidal ideation severity", "suicidal_ideation_severity", "suicidal ideation severity"),
    ("homicidal ideation severity", "homicidal_ideation_severity", "homicidal ideation severity"),
]
# Cognitive model block labels, in order.
COGNITIVE_MODEL_FIELDS = [("situation", "Situation"), ("automatic_thoughts", "Automatic Thoughts"),
                          ("emotion", "Emotions"), ("behavior", "Behavior")]
# ---------------------------------------------------------------- end fixed values (profiles)
