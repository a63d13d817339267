"""They have to be exactly these for results to agree."""

# Emoji that are stripped from chats (faces, symbols, transport, flags).
EMOJI_PATTERN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"

# Word tokens (runs of letters and digits, or one other sign)
# and the token limit of the text encoder.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
MAX_TOKENS = 512

# Pipeline defaults.
WINDOW_LENGTH = 20
WINDOW_STEP = 1
EMBEDDING_DIMS = 768
NEAREST_PER_CLUSTER = 5
NEAREST_TO_SEEDS = 10
BATCH_SIZE = 8
GROUP_BATCH_ROWS = 5000
BINARY_CUTOFF = 7.0
SPLIT_SEED = 1

# Positions in the 29-column message log.
LOG_COLUMN_COUNT = 29
ALLIANCE_POSITION = 1
TEXT_POSITION = 4
SCORE_POSITIONS = (6, 8, *range(10, 29))
PROFILE_POSITIONS = (8, 11, 12, 13, 14, 15, 16, 19, 24, 25)
SEED_POSITION = 8
LABEL_POSITION = 12

# Shown priority labels.
PRIORITY_LABELS = {"low": "Low", "standard": "Standard", "medium": "Medium", "high": "High"}

# Axes of the trait chart, in the order of the six scores.
TRAIT_LABELS = (
    "Bullying",
    "Sexual Content",
    "Vulgarity",
    "Drug / Alcohol",
    "Public Threat",
    "Extremism",
)

# Queue views, as the text each one looks for in the priority.
QUEUE_VIEWS = ("all", "high", "medium", "standard", "low")

# Notes shown beside items from a region, and the text elsewhere.
REGION_NOTES = {
    "South East Asia": (
        "The word swastika comes from Sanskrit: स्वस्तिक, romanized: svastika, meaning "
        "'conducive to well-being'. In Hinduism, the right-facing symbol (clockwise) (卐) is "
        "called swastika, symbolizing surya ('sun'), prosperity and good luck."
    )
}
NO_REGION_NOTE = "N/A"

# Confirmation texts.
IGNORE_ACTION = "Ignore"
IGNORE_TEXT = "The reviewed item will be ignored."
CLASSIFY_PREFIX = "The reviewed item will be classified as "
