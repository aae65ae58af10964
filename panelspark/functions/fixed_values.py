"""Values that are part of the definition of a result."""

# Measure code -> full name.
MEASURE_NAMES = {
    "K&A": "Kidnapping and Abduction",
    "DD": "Dowry Deaths",
    "AoW": "Assault on Women",
    "AoM": "Assault on Minors",
    "DV": "Domestic Violence",
    "Rape": "Rape",
}

# Keyword groups of a question, tried in this order.
KEYWORD_GROUPS = {
    "kidnapping": ["kidnap", "abduct", "kidnapping", "abduction"],
    "rape": ["rape", "sexual assault", "sexual violence"],
    "domestic_violence": ["domestic violence", "domestic abuse", "household abuse"],
    "harassment": ["harassment", "stalking", "intimidation"],
    "dowry": ["dowry death", "dowry harassment", "dowry"],
    "trafficking": ["trafficking", "human trafficking"],
    "total_crime": ["total crime", "overall crime", "unsafe", "dangerous"],
}

# Words that set the intent of a question.
TREND_WORDS = ["trend", "increase", "decrease", "change", "growing", "rising"]
COMPARISON_WORDS = ["compare", "comparison", "versus", "vs", "against"]
HIGHEST_WORDS = ["most", "highest", "worst"]
LOWEST_WORDS = ["least", "lowest", "safest"]

# Answer text when a cluster has no measure above the mean, and
# when a question names nothing that can be answered.
NO_DOMINANT_MEASURE = "No significantly high crime rates"
NO_ANSWER = "I couldn't find relevant information for your query."
