"""Fixed values.

Everything in this module is a format, word list, pattern or default that
must have exactly this value for results to agree; nothing here is logic.
"""

# --- cleaning -------------------------------------------------------------
FORWARD_TAG = "---------- Forwarded message ---------"
MIN_WORDS = 10
ATTRIBUTION = r"(^On.*wrote.*)|(^Am.*schrieb.*)"
# One attribution line only, for the opt-in strict mode.
ATTRIBUTION_STRICT = r"^(On\b[^\n]*\bwrote:|Am\b[^\n]*\bschrieb\b[^\n]*:)[^\S\n]*$"

# --- whitespace and punctuation -------------------------------------------
# The characters str.split() and str.strip() treat as whitespace, once as a
# regular-expression class body and once spelled out.
WS = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- chat markers: prompt start, prompt end, response start, response end --
CHAT_MARKERS = {
    "llama": (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n",
        "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
        "",
        "<|eot_id|>",
    ),
    "mistral": ("[INST] ", " [/INST]", "<s>", "</s>"),
    "phi": ("<s><|user|> ", "<|end|><|assistant|> ", "", "<|end|>"),
}

# --- prompt texts -----------------------------------------------------------
SYSTEM_PREAMBLE = (
    "Your role is that of a helpful automated email assistant. I will provide you with a "
    "short instruction, and you have to write a well-formed email in my style following this "
    "instruction. Be sure to follow my email writing style!  In case you see a nonsensical "
    "instruction, you should not reply with an email, but with the expression \"Sorry, but I "
    "don't get it.\""
)
RAG_PREAMBLE = (
    "Extract specific information from these previous e-mails only if it is relevant to the "
    "current e-mail you have to write.\n\nPrevious e-mails:\n{rag_context}"
)
THREAD_PREAMBLE = "This is the current email thread:\n\n{threading_context}"
SUMMARY_TEMPLATE = (
    "Summarize the following email that I wrote, in an imperative form, in one or two or "
    "maximum three sentences, and make sure to include relevant information, without copying "
    "the email content itself. The summary should look like an instruction directing someone "
    "to write the same email, and start with Instruction: \n"
    "Here is the email text:\n{email} "
)
RAG_ITEM_HEAD = "E-MAIL CONTENT:\n"
ITEM_TAIL = "\n\n---\n\n"
INSTRUCTION_KEY = "Instruction: "
INSTRUCTION_SEPARATOR = "\n\nInstruction: "

# --- boilerplate removed from generated replies, in this order --------------
REPLY_LITERAL = "Here is the email:\n"
REPLY_PATTERNS = (r"SUBJECT:.*\n", r"Subject:.*\n", r"E-MAIL CONTENT:.*\n")

# --- defaults ----------------------------------------------------------------
SEED = 41
RELEVANCE_THRESHOLD = 0.2
PROMPT_RAG_EMAILS = 0
PROMPT_THREAD_EMAILS = 0
CACHED_NEIGHBOURS = 10
CHUNK_SIZE = 3000
CHUNK_OVERLAP = 3000
MAX_PAIR_TOKENS = 512
CHUNK_SEPARATORS = ("\n\n", "\n", " ", "")
DIVERGENCE_SCALE = 5.0
DIVERGENCE_POINTS = 25
