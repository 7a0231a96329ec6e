"""Word lists, lookup tables and weights that results depend on."""

# Meanings of emoji. Of a key given twice the last counts; keys of two code points never match a single one.
EMOJI = {
    "😀": "happy", "😃": "happy", "😄": "happy", "😁": "grinning", "😆": "laughing", "😅": "relieved",
    "🤣": "laughing", "😂": "tears_of_joy", "🙂": "slightly_happy", "😊": "smile", "😇": "angel", "🥰": "love",
    "😍": "heart_eyes", "🤩": "starstruck", "😘": "kiss", "😗": "kiss", "😋": "yum", "😛": "tongue",
    "😜": "wink_tongue", "🤪": "crazy", "😎": "cool", "🤓": "nerd", "🧐": "monocle", "😏": "smirk",
    "😒": "unamused", "😞": "disappointed", "😔": "pensive", "😟": "worried", "😕": "confused", "🙁": "frown",
    "☹️": "frown", "😣": "persevering", "😖": "confounded", "😫": "tired", "😩": "weary", "🥺": "pleading",
    "😢": "crying", "😭": "sobbing", "😤": "angry", "😠": "angry", "😡": "rage", "🤬": "cursing",
    "🤯": "mind_blown", "😳": "flushed", "🥵": "hot", "🥶": "cold", "😱": "screaming", "😰": "anxious",
    "😥": "sad_relieved", "😓": "downcast_sweat", "🤗": "hugging", "🤔": "thinking", "🤭": "hand_over_mouth",
    "🤫": "shushing", "🤥": "lying", "😶": "no_mouth", "😐": "neutral", "😑": "expressionless", "😬": "grimacing",
    "🙄": "eye_roll", "😯": "hushed", "😧": "anguished", "😲": "astonished", "🥱": "yawning", "😴": "sleeping",
    "🤤": "drooling", "👍": "thumbs_up", "👎": "thumbs_down", "👏": "clapping", "🙌": "raised_hands", "💪": "strong",
    "🔥": "fire", "💯": "hundred", "⭐": "star", "🌟": "glowing_star", "💫": "dizzy_star", "✨": "sparkles",
    "❤️": "heart", "💔": "broken_heart", "💩": "poop", "🚀": "rocket", "✅": "check", "❌": "cross",
    "⚠️": "warning", "💰": "money", "🎉": "party", "🎊": "confetti", "👀": "eyes", "🤦": "facepalm",
    "🤷": "shrug", "💀": "skull", "☠️": "skull_crossbones", "🙏": "prayer", "👌": "ok", "✌️": "peace",
    "🤞": "crossed_fingers", "❤": "heart", "💗": "heart", "💖": "heart", "💕": "hearts", "🥳": "partying",
    "😻": "heart_eyes_cat",
}

# Slang and dialect words with what they stand for.
SLANG = {
    "awsm": "awesome", "awsome": "awesome", "gud": "good", "gd": "good", "idk": "i do not know", "brb": "be right back",
    "lol": "laughing out loud", "ty": "thank you", "thx": "thanks", "plz": "please", "pls": "please", "u": "you",
    "r": "are", "n": "and", "b": "be", "v": "very", "bcoz": "because", "bcaz": "because", "k": "ok", "okey": "okay",
    "gr8": "great", "prodt": "product", "osm": "awesome", "nyc": "nice", "lve": "love", "dis": "this", "dat": "that",
    "wat": "what", "boht": "very", "accha": "good", "sahi": "right", "mast": "awesome", "bekaar": "bad",
    "bakwas": "nonsense", "swalpa": "little", "beku": "want", "superagide": "super", "chennagide": "good", "alla": "not",
    "illa": "no",
}

# Phrases of the cleaner's template check.
CLEANER_TEMPLATES = (
    "i love this product", "best product ever", "worst product ever", "highly recommend", "do not buy", "five stars",
    "one star", "great product", "terrible product", "amazing product", "horrible product", "waste of money",
    "worth every penny", "exceeded my expectations", "very disappointed", "very satisfied", "must buy", "stay away",
    "total waste", "love it", "hate it", "perfect product", "defective product", "nice product good quality",
    "good product nice quality", "awesome product love it",
)

# Phrases of the fake-review detector, in the order in which flags name them.
FAKE_TEMPLATES = (
    "i love this product", "best product ever", "worst product ever", "highly recommend this", "do not buy this",
    "five stars", "one star", "great product", "terrible product", "amazing product", "horrible product",
    "waste of money", "worth every penny", "exceeded my expectations", "very disappointed", "very satisfied", "must buy",
    "stay away from this", "total waste", "perfect product", "defective product", "nice product good quality",
    "good product nice quality", "awesome product love it", "best purchase ever made", "worst purchase ever made",
    "exactly as described", "not as described", "fast shipping great product", "poor quality product",
    "excellent quality product", "would buy again", "never buying again", "received damaged product",
)

# Weights of the fake signals, summed in this order, and the threshold.
FAKE_WEIGHTS = {
    "too_short": 0.10, "too_long": 0.08, "all_caps": 0.22, "repeated_chars": 0.15, "repeated_words": 0.15,
    "excessive_punctuation": 0.18, "template_match": 0.20, "emoji_spam": 0.14, "low_info_density": 0.12,
    "rating_mismatch": 0.15, "spaced_text": 0.25,
}
FAKE_THRESHOLD = 0.45

# Aspects and their keywords; the order decides between them.
TAXONOMY = {
    "battery": ["battery", "charge", "charging", "battery life", "power", "backup"],
    "camera": ["camera", "photo", "picture", "lens", "video", "selfie", "low light", "night mode", "megapixel"],
    "display": ["screen", "display", "resolution", "pixel", "brightness", "amoled", "refresh rate", "hz", "panel"],
    "performance": ["fast", "slow", "speed", "lag", "hang", "processor", "ram", "performance", "smooth", "gaming"],
    "build_quality": ["build", "quality", "material", "durability", "plastic", "glass", "premium", "fragile"],
    "price": ["price", "cost", "value", "money", "expensive", "cheap", "affordable", "deal"],
    "software": ["software", "os", "update", "ui", "interface", "bug", "glitch", "crash", "bloatware"],
    "storage": ["storage", "space", "memory", "gb"],
    "audio": ["sound", "audio", "speaker", "volume", "bass", "headphones", "mic"],
    "customer_support": ["support", "service", "customer care", "warranty", "return", "refund", "repair"],
    "delivery": ["delivery", "shipping", "shipped", "arrived", "packaging", "box"],
}

# Sentiment words.
POSITIVE = (
    "good great excellent amazing awesome fantastic perfect love best superb brilliant outstanding impressive beautiful "
    "nice fast smooth solid gorgeous vibrant accurate happy satisfied incredible worth recommend"
).split()
NEGATIVE = (
    "bad terrible horrible worst awful poor disappointing waste hate slow lag crash bug broken defective useless trash "
    "garbage unhappy frustrating drain grainy blurry scratched"
).split()
NEGATORS = "not no never n't cannot hardly barely doesn't don't didn't".split()
INTENSIFIERS = "very really extremely super so too absolutely insanely highly entirely completely totally".split()

# Phrases of sarcasm; a question mark makes the white space before it optional.
SARCASM = (
    "oh great", "just what i needed", r"love how it does\s?n't", "what a joke", "thanks for nothing", "brilliant design", "yeah, right",
)

# Words that mark the two romanised dialects.
HINGLISH = "boht accha hai nahi kar sahi badhiya mast bekaar".split()
KANGLISH = "alla ide chennagide maadi neene beku superagide".split()

# Display names of languages.
LANGUAGES = {
    "en": "English", "hi": "Hindi", "kn": "Kannada", "ta": "Tamil", "te": "Telugu", "fr": "French", "de": "German",
    "es": "Spanish", "pt": "Portuguese", "zh-cn": "Chinese (Simplified)", "zh-tw": "Chinese (Traditional)",
    "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "ru": "Russian", "it": "Italian", "nl": "Dutch", "mr": "Marathi",
    "bn": "Bengali", "gu": "Gujarati", "ml": "Malayalam", "pa": "Punjabi", "ur": "Urdu",
}

# Scripts in the order in which they are tried.
SCRIPTS = (
    ("hi", r"[\x{0900}-\x{097F}]"), ("kn", r"[\x{0C80}-\x{0CFF}]"), ("ta", r"[\x{0B80}-\x{0BFF}]"),
    ("te", r"[\x{0C00}-\x{0C7F}]"), ("ar", r"[\x{0600}-\x{06FF}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"),
    ("ja", r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"), ("ko", r"[\x{AC00}-\x{D7AF}]"),
)
