"""Fixed values.

Results depend on these being exactly what they are, so they are stated here as plain text, together
and in their natural order. Everything else in the package is derived from them.
"""

# File name endings that count as documents (upper or lower case). `.tif` is not one of them.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".gif", ".pdf")

# Words that announce a serial number, in order of priority.
SERIAL_CUES = (
    "número de serie", "nº de serie", "no. de serie", "num. de serie",
    "serie", "serial", "serial number", "id", "código", "folio", "factura",
    "ticket", "recibo", "orden", "pedido", "documento", "contrato",
    "expediente", "registro", "unique id", "reference",
)

# What may stand between a cue and its serial number, and the number itself.
SERIAL_TAIL = r"\s*[:\-#]?\s*([A-Z0-9\-/]+)"

# A word given without a pattern: the word, separators, then the next run of non-blank characters.
WORD_TAIL = r"[:\s-]*(\S+)"

# Separators skipped after a label, besides white space, and how far a literal search then looks.
LABEL_SEPARATORS = ":=-"
SNIPPET_WIDTH = 100

# The value taken from a snippet: a number, else a whole alphanumeric word, else letters.
NUMBER = r"[-+]?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?"
ALNUM_WORD = r"[A-Za-z0-9]+"
LETTERS = r"[a-zA-Z]+"

# Dates next to a label: day first or year first, with slashes or dashes.
DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}"

# Text that counts as a number once spaces and commas are dealt with.
NUMERIC = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"

# Rows of a table that enter its signature where only a sample of it is compared (by default all do).
SIGNATURE_ROWS = 8

# Table layouts, in the order in which a lookup tries them; those looked for unless others are named.
LAYOUTS = ("lattice", "stream", "aligned")
FLAVORS = LAYOUTS[:2]

# Lines that a table whose columns only line up has at least.
ALIGNED_LINES = 3
