"""Fixed values of the data model: labels, tokens, thresholds, strings."""

# Label vocabularies, compared in lower case.
FIGURE_LABELS = ("figure", "image", "picture", "chart", "diagram", "plot")
TABLE_LABELS = ("table",)
CAPTION_LABELS = ("image_caption", "caption", "figure_caption")

# Numeric thresholds.
GRID_MAX = 999.0
MIN_CROP_PX = 2
MIN_TABLE_SPAN = 0.01
TABLE_CROP_PADDING = 0.02
DIGIT_COVERAGE = 0.8
CHROME_MIN_PAGES, CHROME_FRACTION, CHROME_MAX_CHARS = 3, 0.6, 80
CONTEXT_CHARS, PROBE_CHARS = 2000, 3000
TITLE_FLOOR, TITLE_SIMILARITY = 10, 0.75

# Strings of the output format.
DESC_HEADER = "Image description."
PLACEHOLDER_BLOCK = "> **Image.** [not displayed]\n"
UNAVAILABLE = "[figure description unavailable]"

#: The token that stands for a figure until its description is put in.
TOKEN_HEAD, TOKEN_TAIL = "⟦FIG:", "⟧"
TOKEN = TOKEN_HEAD + r"([^⟧]+)" + TOKEN_TAIL
ANY_TOKEN = TOKEN_HEAD + r"[^⟧]+" + TOKEN_TAIL
