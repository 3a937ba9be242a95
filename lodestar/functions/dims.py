"""Small fixed dimensions: curves, update dates, word lists, weights."""

from __future__ import annotations

# Click-through rates in percent by position.
CTR_CURVES = {
    "sistrix": (28.5, 15.7, 11.0, 8.0, 7.2, 5.1, 4.0, 3.2, 2.8, 2.5),
    "awr": (31.7, 24.7, 18.7, 13.6, 9.5, 6.2, 4.2, 3.1, 2.4, 1.9),
    "conservative": (20.0, 12.0, 8.0, 5.5, 4.0, 3.0, 2.2, 1.8, 1.5, 1.2),
    "backlinko": (27.6, 15.8, 11.0, 8.4, 6.3, 4.9, 3.9, 3.3, 2.7, 2.4),
}

# Search engine updates.
UPDATES = [
    ("March 2024 Core Update", "2024-03-05", "core"),
    ("June 2024 Spam Update", "2024-06-20", "spam"),
    ("August 2024 Core Update", "2024-08-15", "core"),
    ("November 2024 Core Update", "2024-11-11", "core"),
    ("December 2024 Spam Update", "2024-12-19", "spam"),
    ("March 2025 Core Update", "2025-03-13", "core"),
    ("June 2025 Core Update", "2025-06-10", "core"),
    ("September 2025 Core Update", "2025-09-15", "core"),
    ("December 2025 Core Update", "2025-12-01", "core"),
    ("March 2026 Core Update", "2026-03-10", "core"),
]

# Signal words of search intent, for keyword lists.
INTENT_WORDS = {
    "transactional": ["buy", "kopen", "price", "prijs", "discount", "korting", "order", "bestellen", "deal", "cheap", "goedkoop", "shop", "purchase", "coupon", "subscribe", "abonnement"],
    "commercial": ["best", "beste", "review", "vs", "versus", "compare", "vergelijk", "top", "alternative", "alternatief", "recommended", "aanbevolen", "which", "welke"],
    "informational": ["what", "wat", "how", "hoe", "why", "waarom", "when", "wanneer", "who", "wie", "guide", "gids", "tutorial", "learn", "leren", "example", "voorbeeld", "meaning", "betekenis", "definition"],
}
# Value of an intent, question words.
INTENT_VALUES = {"transactional": 3, "commercial": 2, "informational": 1, "navigational": 1}
QUESTION_WORDS = ["what", "how", "why", "wat", "hoe", "waarom", "when", "wanneer"]

# Signal words of search intent, for result pages, in the order of the test.
SERP_INTENT = {
    "navigational": ["login", "sign in", "website", "official", ".com", ".org"],
    "transactional": ["buy", "purchase", "order", "download", "subscribe", "deal", "discount", "coupon", "price", "pricing", "cost", "cheap", "free trial"],
    "commercial": ["best", "top", "review", "comparison", "vs", "versus", "alternative", "vs.", "compared to", "pros and cons"],
    "informational": ["how to", "what is", "what are", "why", "guide", "tutorial", "learn", "example", "definition", "meaning", "explain"],
}
SERP_TITLE_INTENT = {"commercial": ["best", "top", "review", "vs"], "informational": ["how to", "guide", "what", "tutorial"]}

# Filler words at the start of a heading, in the order they are cut.
TOPIC_FILLERS = ["the ", "a ", "an ", "our ", "your ", "my ", "about "]

# Words that tell a keyword's region (a keyword may also end in those of nl and de).
REGION_WORDS = {
    "nl": [" van ", " voor ", " het ", " een ", " zijn ", " worden ", " naar ", " wat ", " hoe ", " waar ", " beste ", " boeken ", " inhuren ", " spreker", " specialist", " advies", " opleiding", " kosten"],
    "de": [" für ", " und ", " der ", " die ", " das ", " wie ", " berater"],
    "fr": [" pour ", " les ", " des ", " dans ", " avec ", " comment "],
}
# Location and language of a region.
REGIONS = [
    ("nl", 2528, "nl"), ("be", 2056, "nl"), ("be-fr", 2056, "fr"), ("de", 2276, "de"), ("fr", 2250, "fr"), ("uk", 2826, "en"), ("us", 2840, "en"),
    ("es", 2724, "es"), ("it", 2380, "it"), ("pt", 2620, "pt"), ("br", 2076, "pt"), ("au", 2036, "en"), ("ca", 2124, "en"), ("at", 2040, "de"),
    ("ch", 2756, "de"), ("se", 2752, "sv"), ("dk", 2208, "da"), ("no", 2578, "no"), ("pl", 2616, "pl"), ("jp", 2392, "ja"),
]

# Anchors that say nothing.
GENERIC_ANCHORS = [
    "click here", "read more", "learn more", "here", "this", "link", "more", "lees meer", "bekijk", "klik hier", "meer info", "meer", "see more",
    "view", "details", "info", "ga naar", "bekijk meer", "meer informatie", "lees verder", "verder lezen",
]

# Page health weights, thresholds of thin and orphan pages, patterns in the order of the test.
HEALTH_WEIGHTS = {"thin_content": 25, "missing_canonical": 15, "orphan_page": 15, "poor_structure": 15, "missing_meta": 10, "deep_crawl_depth": 10, "traffic_decay": 10}
PAGE_THRESHOLDS = [("blog", 800, 3), ("product", 200, 2), ("category", 300, 5), ("service", 500, 3), ("location", 400, 2), ("homepage", 300, 0), ("default", 300, 3)]
PAGE_PATTERNS = [
    ("blog", "(?i)/blog/|/article/|/post/|/nieuws/|/news/|/magazine/"),
    ("product", "(?i)/product/|/shop/|/item/|/p/|/artikel/"),
    ("category", "(?i)/category/|/collection/|/tag/|/categorie/|/c/"),
    ("service", "(?i)/service/|/dienst/|/solution/|/oplossing/"),
    ("location", "(?i)/location/|/vestiging/|/filiaal/|/store/|/winkel/"),
]
