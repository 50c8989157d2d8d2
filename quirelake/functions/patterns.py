"""Word lists and patterns that results depend on. All are fixed values; every pattern is Java's, Unicode-aware."""

#: Everything Python's str.split() and str.strip() take for a blank.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "

# Number words of chapter labels, and patterns of sections, front and back matter.
NUMBER_WORDS = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|"
    "nineteen|twenty(?:\\s*-\\s*\\w+)?|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred"
)
_NUM = r"(?:\d+|[ivxlcdm]+|" + NUMBER_WORDS + ")"
NAMED_SECTIONS = ("prologue", "epilogue", "foreword", "preface", "introduction", "afterword", "appendix", "interlude")
SECTION = (
    r"(?iuU)^(?:(?:chapter|ch\.?)\s+" + _NUM + r"\b|part\s+" + _NUM + r"\b|" + "|".join(NAMED_SECTIONS)
    + r"|(?:\d+|[ivxlcdm]+)\.?\s*fejezet\b|fejezet\s+(?:\d+|[ivxlcdm]+)\b|(?:\d+|[ivxlcdm]+)\.?\s*r[eé]sz\b|r[eé]sz\s+(?:\d+|[ivxlcdm]+)\b).*$"
)
#: Titles may have the number words from twenty on in one.
PART = r"(?iuU)^\s*(?:part\s+" + _NUM.replace("\\s*-\\s*", "\\s*-?\\s*") + r"\b|(?:\d+|[ivxlcdm]+)\.?\s*r[eé]sz\b|r[eé]sz\s+(?:\d+|[ivxlcdm]+)\b)"
#: English only, as web books have it, and without a length of number words.
EPUB_SECTION = r"(?iuU)^\s*(?:(?:chapter|ch\.?)\s+" + _NUM + r"|part\s+" + _NUM + "|" + "|".join(NAMED_SECTIONS) + r")\b.*$"
#: Headings inside a chapter's text: chapters to twenty and its compounds, parts to ten.
TEXT_SECTION = (
    r"(?iuU)^\s*(?:(?:chapter|ch\.?)\s+(?:\d+|[ivxlcdm]+|" + NUMBER_WORDS.partition("|thirty")[0] + r")|part\s+(?:\d+|[ivxlcdm]+|"
    + NUMBER_WORDS.partition("|eleven")[0] + ")|" + "|".join(NAMED_SECTIONS) + r")\b.*$"
)
DIVIDER = r"(?iuU)^(?:part|" + "|".join(NAMED_SECTIONS) + r")\b"
SKIP_TITLE = r"(?iuU)^(?:table\s+of\s+contents|contents|copyright\b|other\s+books\s+by\b|tartalom(?:jegyzék)?\b)$"
FRONT_MATTER = r"(?iuU)^(?:table\s+of\s+contents|contents|copyright\b|other\s+books\s+by\b)"
BACK_MATTER = r"(?iuU)^(?:you\s+have\s+just\s+finished\s+reading\b|about\s+the\s+author\b|acknowledgements?\b|a\s+szerzőről\b)"
COPYRIGHT = r"(?iuU)\bcopyright\b|all rights reserved|licensed for your enjoyment only|please buy an additional copy|minden\s+jog\s+fenntartva"
#: What a web book's pages are left out for: the English part of the above.
WEB_BACK_MATTER = BACK_MATTER.replace(r"|a\s+szerzőről\b", "")
WEB_COPYRIGHT = COPYRIGHT.partition(r"|minden\s+jog")[0]
PROMOTION = r"(?iu)\bfeel free to tweet\b|\bevery writer likes to receive a review\b|\bother books by\b"
TOC_CHAPTER = r"(?iuU)\b(?:chapter|fejezet)\s+" + _NUM + r"\b|\b(?:\d+|[ivxlcdm]+)\.?\s*fejezet\b"

# Stop words whose counts tell Hungarian from English.
HUNGARIAN = "a az és hogy nem is egy de meg mint aki ami már még volt van csak majd után előtt".split()
ENGLISH = "a an the and that not is was of to in he she it with for as but had his her".split()

# Words that call for a tag, in the order in which they are tried.
LAUGHTER = r"(?iu)\b(laugh|laughs|laughed|laughing|chuckl|giggl|grinned|grinning|amused|teased|joked|snickered|cackled|burst out laughing|couldn't help laughing)\b"
SIGH = r"(?iu)\b(sigh|sighs|sighed|sighing|exhale|exhaled|breathed out|let out a (?:long |weary |heavy |deep )?breath|heaved a sigh|resigned(?:ly)?)\b"
DISSATISFACTION = (
    r"(?iu)\b(grumbl|mutter|growl|snapp|barked|hiss|scowl|gritted|glared|glaring|frowned|frowning|stormed|huffed|fumed|"
    r"seethed|snarled|glowered|bristled|sneered at|slammed|threw.*down|shook.*head in disgust)\b"
)
CONFIRMATION = r"(?iu)\b(nod|nodded|nodding|agreed|confirm|confirmed|affirm|affirmed|assented|concurred|gave a nod|tilted his head in agreement|tilted her head in agreement)\b"
WHISPER = r"(?iu)\b(whisper|whispered|breathed|murmured|under his breath|under her breath|barely audible|in a low voice|hissed softly)\b"
ACTION = (
    r"(?iu)\b(ran|rushed|sprinted|struck|fell|crashed|burst|grabbed|pulled|pushed|slammed|exploded|screamed|fired|attacked|fled|chased|leaped|"
    r"jumped|stabbed|shot|hit|smashed|broke|shattered)\b"
)
SLOW = r"(?iu)\b(slowly|gently|quietly|softly|carefully|tenderly|silently|solemnly|mournfully|peacefully|dreamily)\b"
TAGS = ((LAUGHTER, "[laughter]"), (SIGH, "[sigh]"), (DISSATISFACTION, "[dissatisfaction-hnn]"), (CONFIRMATION, "[confirmation-en]"))

# Verbs of attribution and the shape of a name.
SAID = (
    "said|replied|asked|whispered|shouted|cried|muttered|exclaimed|called|added|continued|laughed|sighed|groaned|snapped|retorted|insisted|"
    "demanded|pleaded|began|noted|observed|remarked|growled|yelled|murmured|gasped|stammered|shrieked"
)
MENTION_VERBS = (
    "said|replied|asked|answered|whispered|shouted|cried|muttered|exclaimed|called|added|continued|laughed|sighed|groaned|snapped|retorted|"
    "insisted|demanded|pleaded|began|noted|observed|remarked"
)
QUOTE_VERBS = "said|replied|asked|whispered|shouted|cried|muttered|exclaimed|called"
MENTION_STOP = "The A An He She It They We You I But And Or So As In On At By For His Her Their Its Our Your".split()
NAME = r"[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){0,2}"
ATTRIBUTION_SENTENCE = r"(?iuU)^(?:" + NAME + r"|he|she|they)\s+(?:" + SAID + r")(?:\s+\w+){0,4}[.!?]?$"
PAIRED_QUOTE = r'"[^"]{2,}"|“[^”]{2,}”|„[^”]{2,}”|«[^»]{2,}»'
DASH_SPEECH = "^\\s*[-–—]\\s+[A-ZÁÉÍÓÖŐÚÜŰ0-9\"“„«]"
DASH_SPLIT = r"(?=\s+[-–—]\s+)"
DASH_ASIDE = r"^(\s*[-–—]\s+[a-záéíóöőúüű].*?\s+[-–—],)\s*(.+)$"
NARRATION = (
    r"^(?:(?:A|Az|Egy|The|An?)\s+.{0,55}|(?:He|She|They|Ő|Azután|Ekkor)\s+)\b(?:said|replied|asked|nodded|looked|smiled|laughed|sighed|turned|"
    r"stood|stepped|walked|thought|saw|heard|felt|mondta|felelte|kérdezte|bólintott|nézett|elmosolyodott|nevetett|sóhajtott|folytatta|fordult|"
    r"állt|lépett|ment|gondolta|látta|hallotta|érezte)\b"
)

# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = (
    "Mr Mrs Ms Dr Prof Sr Jr St Mt Lt Capt Col Gen Sgt Rev Hon Pres Gov Sen Rep Supt Det No Nos Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec etc vs"
).split()
MULTI_DOT = r"\b(?:e\.g\.|i\.e\.|a\.m\.|p\.m\.|u\.s\.a?\.|u\.k\.|u\.n\.|ph\.d\.)"
# Shapes of lines and clauses.
CAPITALS = "[A-ZÁÉÍÓÖŐÚÜŰ]{2,}"
ROMAN, INITIALS_LINE = "(?i)^[IVXLCDM]+\\.?$", "^(?:[A-Z]\\.\\s*)+[A-Z]\\.?$"
SHORT_CAPS = "^[A-Z0-9][A-Z0-9 '&,:;.-]{1,80}$"
CLAUSE_END = "(?<=[,;:…、，：；])\\s+"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
MAX_SEGMENT = 500

# Seconds of silence after a segment.
PAUSE, PAUSE_DIALOGUE, PAUSE_PARAGRAPH, PAUSE_ELLIPSIS = 0.35, 0.55, 0.85, 1.5
# Colours a name may be given.
COLOURS = "#FFD700 #FF6B6B #4ECDC4 #45B7D1 #96CEB4 #FFEAA7 #DDA0DD #98D8C8 #F7DC6F #BB8FCE #85C1E9 #82E0AA #F0B27A #AED6F1 #A9DFBF".split()
# Names that name no speaker.
NON_SPEAKERS = ("", "narrator", "narrátor", "narration", "elbeszélő", "unknown", "ismeretlen", "none", "null")
