"""Fixed values that must equal the reference for equal results: the word
lists and pattern fragments of the scoring, category, acknowledgement and
order; alternatives are JavaScript-regex fragments matched as whole ASCII
words, ignoring case, unless noted.
"""

# ---------------------------------------------------------------- fixed values
# Acknowledgement of a review comment by the PR author.
ACK_1 = ["fixed", "done", "good catch", "great catch", "you're right", "updated",
         "addressed", "thanks", "ty"]
ACK_2 = ["will fix", "fixing", "fixed in", "sorted", "adjusted", "corrected", "resolved"]

# Actionable comment (X2), three groups.
ACTIONABLE_1 = ["should", "consider", "use", "replace", "avoid", "instead", "better to",
                "recommend", "suggest"]
ACTIONABLE_2 = ["this (will|can|could|might)", "you (should|could|can|need to)"]
ACTIONABLE_3 = ["fix", "refactor", "extract", "move", "rename", "remove", "add", "implement"]

# Specific comment (X3): four patterns; the second is case-sensitive.
SPECIFIC_BACKTICK = "`[^`]+`"
SPECIFIC_CALL = r"[a-z][a-zA-Z]+\(\)"          # preceded by \b, no end guard
SPECIFIC_PLACE = [r"line \d+", "here", "this (function|method|variable|class|file)"]
SPECIFIC_QUOTED = '"[^"]{3,30}"'

# High-value comment (X4), five groups.
HIGH_VALUE = [
    ["sql injection", "xss", "csrf", "race condition", "memory leak", "deadlock"],
    ["authentication", "authorization", "privilege", "secret", "token", "password"],
    [r"n\+1", "query", "index", "cache", "performance", "complexity", r"O\(n\)"],
    ["coupling", "cohesion", "solid", "srp", "separation of concerns", "abstraction"],
    ["vulnerability", "cve", "security", "unsafe", "exploit"],
]

# Low-value comment (X5): prefix, whole text, formatting words.
LOW_VALUE_PREFIX = ["nit", "nitpick", "minor"]          # then ':' or white space
LOW_VALUE_WHOLE = ["lgtm", "looks good", "nice", "great job"]  # optional final '.'
LOW_VALUE_WORDS = ["formatting", "whitespace", "indentation", "typo", "spelling"]

# Category inference (X9), tried in this order; otherwise "style".
CATEGORY_RULES = [
    ("security", ["sql", "inject", "xss", "csrf", "auth", "secret", "token", "password",
                  "vuln", "cve", "unsafe"]),
    ("performance", [r"n\+1", "query", "cache", "index", r"O\(n\)", "performance", "slow",
                     "memory"]),
    ("architecture", ["coupling", "srp", "solid", "abstraction", "architect",
                      "design pattern", "layer"]),
    ("correctness", ["null", "undefined", "error", "exception", "edge case", "race",
                     "deadlock"]),
]

# Evaluation specificity (X25): all matches counted.
EVAL_SPECIFIC_PLACE = [r"line \d+", "this (function|method|class|variable)"]

# Evaluation actionability (X26), three groups.
EVAL_ACTIONABLE_1 = ["should", "consider", "use", "replace", "avoid", "instead",
                     "recommend", "suggest"]
EVAL_ACTIONABLE_2 = ["fix", "refactor", "extract", "move", "rename", "remove", "add",
                     "implement"]
EVAL_ACTIONABLE_3 = ["you (should|could|can|need to)", "this (will|can|could)"]

# Default PR-template sections (X31): id, header pattern, placeholder pattern,
# label, description.
DEFAULT_SECTIONS = [
    ("what", r"##\s*(what|summary|description|changes?)",
     r"\[.*?(describe|add a description|what does).*?\]", "## What",
     "A description of what this PR does"),
    ("why", r"##\s*(why|motivation|context|reason)",
     r"\[.*?(why|motivation|reason).*?\]", "## Why", "Why this change is needed"),
    ("testing", r"##\s*(test|testing|how.*test|verification)",
     r"\[.*?(describe.*test|how.*verify|test.*approach).*?\]", "## Testing",
     "How this was tested"),
]

CATEGORIES = ["security", "architecture", "performance", "style", "correctness"]
SEVERITIES = ["critical", "warning", "info", "suggestion"]
TRUSTED_ASSOCIATIONS = ["OWNER", "MEMBER", "COLLABORATOR"]
# ------------------------------------------------------------ end fixed values
