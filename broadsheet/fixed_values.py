"""Word lists and lookup tables whose values decide results.

These are the default dimensions. Operators never read them directly: each takes its lists as an
argument, so a deployment can pass its own tables. Gazetteers and name aliases have no default; load
them with :func:`broadsheet.dims.read_gazetteer` and :func:`broadsheet.dims.read_aliases`.
"""

# Common words that are never keywords.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "up", "about", "into", "through", "during",
    "is", "are", "was", "were", "been", "be", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we",
    "এবং", "বা", "কিন্তু", "তবে", "যে", "যা", "যার", "যাকে", "যাদের",
    "এ", "ও", "সে", "তিনি", "তারা", "আমি", "আমরা", "তুমি", "তোমরা",
]

# Common words of the simple keyword extractor.
SIMPLE_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at",
    "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "এ", "এর", "ও", "এবং", "যে", "যা", "এই", "সে", "তার",
]

# Theme -> keywords, in order.
THEMES = {
    "Election Commission": [
        "election", "election commission", "EC", "voter", "voting",
        "নির্বাচন", "নির্বাচন কমিশন", "ভোটার", "ভোট",
    ],
    "Judiciary": [
        "court", "supreme court", "high court", "judge", "justice",
        "আদালত", "সুপ্রিম কোর্ট", "হাইকোর্ট", "বিচারক",
    ],
    "Reform": ["reform", "reformation", "restructure", "overhaul", "সংস্কার", "পুনর্গঠন"],
    "Democracy": [
        "democracy", "democratic", "autocracy", "dictatorship",
        "গণতন্ত্র", "গণতান্ত্রিক", "স্বৈরাচার",
    ],
    "Human Rights": [
        "human rights", "rights violation", "torture", "disappearance",
        "মানবাধিকার", "নির্যাতন", "গুম",
    ],
    "Economy": [
        "economy", "economic", "inflation", "GDP", "budget",
        "অর্থনীতি", "মূল্যস্ফীতি", "বাজেট",
    ],
    "Law and Order": [
        "law and order", "police", "security", "crime", "violence",
        "আইন শৃঙ্খলা", "পুলিশ", "নিরাপত্তা", "অপরাধ",
    ],
}

# Words that mark speeches.
SPEECH_KEYWORDS = [
    "speech", "spoke", "said", "stated", "declared", "announced",
    "address", "remarks", "commented", "expressed", "rally", "meeting",
    "বক্তব্য", "বক্তা", "বলেন", "বলেছেন", "ঘোষণা", "মন্তব্য",
    "সভা", "সমাবেশ", "জনসভা",
]

# Words that mark positions taken.
STANCE_KEYWORDS = [
    "position", "stance", "opinion", "view", "oppose", "support",
    "demand", "call for", "urge", "criticize", "condemn", "praise",
    "অবস্থান", "মতামত", "দাবি", "সমর্থন", "বিরোধিতা", "নিন্দা",
]

# Topic -> keywords, in order.
TOPICS = {
    "election": ["election", "নির্বাচন", "vote", "voting"],
    "government": ["government", "সরকার", "administration"],
    "economy": ["economy", "অর্থনীতি", "economic", "price"],
    "corruption": ["corruption", "দুর্নীতি", "scandal"],
    "democracy": ["democracy", "গণতন্ত্র", "democratic"],
    "protest": ["protest", "আন্দোলন", "demonstration"],
    "reform": ["reform", "সংস্কার", "change"],
    "justice": ["justice", "ন্যায়বিচার", "court", "legal"],
}

# Reporting verbs that mark a key sentence.
REPORTING_VERBS = [
    "বলেন", "বলেছেন", "said", "stated", "announced", "declared", "urged", "called for",
]

# Stance word lists and labels.
POSITIVE_WORDS = ["support", "welcome", "praise", "good", "সমর্থন", "স্বাগত"]
NEGATIVE_WORDS = ["oppose", "criticize", "condemn", "bad", "বিরোধিতা", "সমালোচনা"]
NEUTRAL_WORDS = ["discuss", "comment", "state", "বলেন", "আলোচনা"]
STANCE_LABELS = ("Supportive", "Critical/Opposing", "Neutral/Informative")
KEYWORD_SUPPORT = ["support", "praise", "welcome", "সমর্থন"]
KEYWORD_OPPOSE = ["oppose", "criticize", "condemn", "বিরোধিতা"]

# Category -> (description, keywords), in order.
TAXONOMY = {
    "Reform": (
        "Articles about political, judicial, electoral, or institutional reforms",
        ["reform", "সংস্কার", "restructure", "পুনর্গঠন", "change", "পরিবর্তন", "overhaul"],
    ),
    "Elections": (
        "Articles about elections, voting, election commission, electoral process",
        ["election", "নির্বাচন", "voting", "ভোট", "ballot", "candidate", "প্রার্থী", "election commission"],
    ),
    "Trial of The Fascist Government": (
        "Articles about trials, prosecution, or accountability of the previous fascist government",
        ["trial", "বিচার", "prosecution", "অভিযোগ", "fascist", "ফ্যাসিস্ট", "স্বৈরাচার", "accountability",
         "জবাবদিহিতা"],
    ),
    "National Security": (
        "Articles about national security, defense, border issues, terrorism, law and order",
        ["security", "নিরাপত্তা", "defense", "প্রতিরক্ষা", "border", "সীমান্ত", "terrorism", "সন্ত্রাস",
         "law and order"],
    ),
    "Conspiracy": (
        "Articles about political conspiracies, plots, or alleged secret plans",
        ["conspiracy", "ষড়যন্ত্র", "plot", "চক্রান্ত", "scheme", "কূটকৌশল", "secret plan"],
    ),
    "External Actors": (
        "Articles about foreign involvement, international relations, external influence",
        ["foreign", "বিদেশী", "international", "আন্তর্জাতিক", "external", "বহিঃস্থ", "India", "ভারত", "USA",
         "China"],
    ),
    "Proportional Representation (PR) system": (
        "Articles about proportional representation electoral system",
        ["proportional representation", "PR system", "সমানুপাতিক প্রতিনিধিত্ব", "electoral system",
         "নির্বাচনী ব্যবস্থা"],
    ),
    "Legal Basis of July Charter": (
        "Articles about July Charter, legal framework, constitutional matters related to July movement",
        ["July Charter", "জুলাই সনদ", "legal basis", "আইনি ভিত্তি", "constitution", "সংবিধান", "July movement"],
    ),
    "Others": ("Articles that don't fit into any of the above categories", []),
}

# Month names and their numbers.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

# Label of an article that matches no party.
DEFAULT_MENTION = "General Politics"

# Patterns and markers removed from one source's page text.
BOILERPLATE_PATTERNS = [
    "ফলো করুন.*?যুগান্তর মেসেঞ্জার",
    "যুগান্তর প্রতিবেদন.*?পিএম",
    "আরও পড়ুন.*?সম্পর্কিত খবর",
    "সর্বশেষ.*?সব খবর",
    "প্রকাশ:.*?পিএম",
    "সম্পর্কিত খবর.*",
    "যুগান্তর.*?হোয়াটসঅ্যাপ.*?মেসেঞ্জার",
]
BOILERPLATE_HEAD_MARKER = "মেসেঞ্জার"
BOILERPLATE_TAIL_MARKER = "সম্পর্কিত খবর"

# Where an article's fields are on a page, tried in this order.
TITLE_SELECTORS = ("h1.article-title", "h1", "h2~title|headline")
BODY_SELECTORS = (".article-content", ".content", ".article-body", ".story-content", ".article-text", ".news-content")
AUTHOR_SELECTORS = (".author", ".byline", ".writer", ".reporter")
CATEGORY_SELECTORS = ("a~category",)
