"""Fixed values.

Everything in this module is a constant whose exact value decides the result
(patterns, replacement texts, word lists).  They are written out in their natural
order.  Patterns are Java regular expressions; where a source pattern used a Python
escape Java reads differently the adjusted form is noted next to it.
"""

# ---------------------------------------------------------------------------
# FIXED VALUE: Python's white space, spelled so Java and RE2 read it the same way (their
# own \\s is ASCII only).
# ---------------------------------------------------------------------------
PY_SPACE = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# ---------------------------------------------------------------------------
# FIXED VALUES: twitter-style preprocessing rules (ordered; pattern, replacement).
# eyes = "[8:=;]", nose = "['`\\-]?"
# '(?d)' keeps '.' from matching only '\n' (Python semantics); '(?U)' makes \d Unicode.
# ---------------------------------------------------------------------------
GLOVE_RULES_REFERENCE = [
    (r"(?d)https?:* ", "<URL>"),
    (r"(?d)www.* ", "<URL>"),
    (r"(?d)\[\[User(.*)\|", "<USER>"),
    (r"<3", "<HEART>"),
    (r"(?U)[-+]?[.\d]*[\d]+[:,.\d]*", "<NUMBER>"),
    (r"[8:=;]['`\-]?[Dd)]", "<SMILE>"),
    (r"[(d]['`\-]?[8:=;]", "<SMILE>"),
    (r"[8:=;]['`\-]?p", "<LOLFACE>"),
    (r"[8:=;]['`\-]?\(", "<SADFACE>"),
    (r"\)['`\-]?[8:=;]", "<SADFACE>"),
    (r"[8:=;]['`\-]?[/|l*]", "<NEUTRALFACE>"),
    (r"/", " / "),
    (r"(?U)[-+]?[.\d]*[\d]+[:,.\d]*", "<NUMBER>"),
    (r"([!]){2,}", "! <REPEAT>"),
    (r"([?]){2,}", "? <REPEAT>"),
    (r"([.]){2,}", ". <REPEAT>"),
    (r"(?d)(.)\1{2,}", "$1 <ELONG>"),
]

# rules='fixed': the first two rules replaced by a proper URL pattern (quirk Q1).
URL_PATTERN_FIXED = r"(?i)\b(?:https?://|www\.)\S+"

# ---------------------------------------------------------------------------
# FIXED VALUES: word-list substitutions (ordered; pattern, replacement).
# Two source patterns were Python NUL escapes ('\0s', '\0rs'); Java spells the NUL
# character '\x00' (quirk Q3).
# ---------------------------------------------------------------------------
WORDLIST_RULES = [
    (r"what's", ""),
    (r"What's", ""),
    (r"\'s", " "),
    (r"\'ve", " have "),
    (r"can't", "cannot "),
    (r"n't", " not "),
    (r"I'm", "I am"),
    (r" m ", " am "),
    (r"\'re", " are "),
    (r"\'d", " would "),
    (r"\'ll", " will "),
    (r"60k", " 60000 "),
    (r" e g ", " eg "),
    (r" b g ", " bg "),
    (r"\x00s", "0"),
    (r" 9 11 ", "911"),
    (r"e-mail", "email"),
    (PY_SPACE + "{2,}", " "),
    (r"quikly", "quickly"),
    (r" usa ", " America "),
    (r" USA ", " America "),
    (r" u s ", " America "),
    (r" uk ", " England "),
    (r" UK ", " England "),
    (r"india", "India"),
    (r"switzerland", "Switzerland"),
    (r"china", "China"),
    (r"chinese", "Chinese"),
    (r"imrovement", "improvement"),
    (r"intially", "initially"),
    (r"quora", "Quora"),
    (r" dms ", "direct messages "),
    (r"demonitization", "demonetization"),
    (r"actived", "active"),
    (r"kms", " kilometers "),
    (r"KMs", " kilometers "),
    (r" cs ", " computer science "),
    (r" upvotes ", " up votes "),
    (r" iPhone ", " phone "),
    (r"\x00rs ", " rs "),
    (r"calender", "calendar"),
    (r"ios", "operating system"),
    (r"gps", "GPS"),
    (r"gst", "GST"),
    (r"programing", "programming"),
    (r"bestfriend", "best friend"),
    (r"dna", "DNA"),
    (r"III", "3"),
    (r"the US", "America"),
    (r"Astrology", "astrology"),
    (r"Method", "method"),
    (r"Find", "find"),
    (r"banglore", "Banglore"),
    (r" J K ", " JK "),
]

# FIXED VALUE: characters dropped after the word-list rules: [ " ' ? , \ . ]
WORDLIST_DROP_CHARS = "[\"'?,\\.]"

# ---------------------------------------------------------------------------
# FIXED VALUES: contraction dictionary (ordered; unanchored regex -> replacement),
# followed by its two trailing entries (punctuation class and whitespace squeeze).
# ---------------------------------------------------------------------------
CONTRACTIONS = [
    ("what's", "what is"),
    ("what're", "what are"),
    ("who's", "who is"),
    ("who're", "who are"),
    ("where's", "where is"),
    ("where're", "where are"),
    ("when's", "when is"),
    ("when're", "when are"),
    ("how's", "how is"),
    ("how're", "how are"),
    ("i'm", "i am"),
    ("we're", "we are"),
    ("you're", "you are"),
    ("they're", "they are"),
    ("it's", "it is"),
    ("he's", "he is"),
    ("she's", "she is"),
    ("that's", "that is"),
    ("there's", "there is"),
    ("there're", "there are"),
    ("i've", "i have"),
    ("we've", "we have"),
    ("you've", "you have"),
    ("they've", "they have"),
    ("who've", "who have"),
    ("would've", "would have"),
    ("not've", "not have"),
    ("i'll", "i will"),
    ("we'll", "we will"),
    ("you'll", "you will"),
    ("he'll", "he will"),
    ("she'll", "she will"),
    ("it'll", "it will"),
    ("they'll", "they will"),
    ("isn't", "is not"),
    ("wasn't", "was not"),
    ("aren't", "are not"),
    ("weren't", "were not"),
    ("can't", "can not"),
    ("couldn't", "could not"),
    ("don't", "do not"),
    ("didn't", "did not"),
    ("shouldn't", "should not"),
    ("wouldn't", "would not"),
    ("doesn't", "does not"),
    ("haven't", "have not"),
    ("hasn't", "has not"),
    ("hadn't", "had not"),
    ("won't", "will not"),
    ("[\"'?,\\.]", ""),
    (PY_SPACE + "+", " "),
]

# FIXED VALUES: function words dropped by the basic cleaning.
BASIC_STOPWORDS = ["a", "and", "of", "the", "to", "on", "in", "at", "is"]

# FIXED VALUES: missing-text sentinel.
NULL_TEXT_SENTINEL = "CVxTz"

# FIXED VALUES: substring flags of the text-statistics block (question words, then terms).
QUESTION_WORDS = ["how", "what", "which", "who", "where", "when", "why"]
FLAG_TERMS = ["ass", "tit", "hell", "cum", "cipa", "sex", "butt", "fuck", "bitch", "cock",
              "fag", "gay", "nazi"]

# FIXED VALUES: default filter characters of the Keras-style tokenizer.
KERAS_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

# FIXED VALUES: the public NLTK English stop-word list (179 words), in its published order.
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain",
    "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn",
    "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# FIXED VALUES: label names of the six-label task.
TARGET_COLUMNS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
