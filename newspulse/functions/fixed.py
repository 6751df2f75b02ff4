"""Word lists, patterns and limits that results depend on."""

# --- Fixed values: sentiment lexicon -------------------------------------
NEGATIVE_WORDS = [
    "급감", "적자", "악화", "부진", "결렬", "파업",
    "위기", "하락", "손실", "쇼크", "감소",
]
POSITIVE_WORDS = [
    "상승", "반등", "승진", "확대", "협력",
    "성장", "개선", "증가", "타결", "수주",
]

# --- Fixed values: stopwords and kept part-of-speech tags ----------------
STOPWORDS = [
    "것", "수", "등", "및", "이", "그", "저", "년", "월", "일",
    "때", "곳", "들", "제", "와", "과", "은", "는", "가",
    "을", "를", "의", "에", "서", "로", "으로", "도", "만", "에서",
    "하다", "되다", "있다", "없다", "이다", "위하다", "통하다",
    "대하다", "관하다", "따르다", "나타나다", "보이다", "말하다",
    "기자", "특파원", "연합뉴스", "뉴스", "보도", "발표", "공개",
    "관련", "대한", "지난", "올해", "지난해", "내년",
    "오전", "오후", "현재", "최근", "앞서", "이번", "다음",
    "억원", "조원", "만원", "달러", "원", "개", "명", "건",
    "퍼센트", "분기", "전년", "동기", "대비",
    "위하", "밝히", "통하", "따르", "전하", "강조하", "설명하",
    "분석하", "전망하", "예상하", "기록하", "달성하", "확대하",
    "증가하", "감소하", "하락하", "나타나", "이루", "받",
]
KEPT_TAGS = ["NNG", "NNP", "VV", "VA"]

# --- Fixed values: boilerplate patterns ----------------------------------
# (?d) lets only \n end a line, (?m) makes ^ and $ line anchors, (?U) gives
# \s and \w their Unicode meaning.
BYLINE = r"(?dmU)\[.*?기자\]"
COPYRIGHT = r"(?dmUs)\(c\)\s*.+?무단\s*전재.*?재배포\s*금지"
RIGHTS_HOLDER = r"(?dmU)저작권자\s*.\s*.+"
REPORTER_LINE = r"(?dmU)^\s*\S+\s+기자\s+[\w.\-@]+\s*$"
CORRESPONDENT_LINE = r"(?dmU)^\s*\S+\s+특파원\s*$"
ARROW_TAIL = r"(?dmU)[▶☞].*$"
BRACKETED_NOTE = r"(?dmU)【.*?】"
END_MARK = r"(?dmU)\(끝\)\s*$"
# A line with an address: whatever follows a later @ also follows the first.
EMAIL_LINE = r"(?dmU)^[^@\n]*+@.*?\.(com|co\.kr|net|org).*$"
EMAIL_LINE_SHORT = r"(?dmU)^[^@\n]*+@.*?\.(com|co\.kr).*$"

BOILERPLATE = [
    BYLINE, COPYRIGHT, RIGHTS_HOLDER, REPORTER_LINE, CORRESPONDENT_LINE,
    ARROW_TAIL, BRACKETED_NOTE, END_MARK, EMAIL_LINE,
]
BOILERPLATE_REALTIME = [BYLINE, RIGHTS_HOLDER, REPORTER_LINE, ARROW_TAIL, EMAIL_LINE_SHORT]

# --- Fixed values: character classes and word patterns -------------------
# (?U) gives \s its Unicode meaning, and is much faster than a class that
# lists the ranges; \x1c-\x1f complete the set Python calls whitespace.
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SENTENCE_END = ".!?다요"
HANGUL_WORD = r"[가-힣]{2,}"
LETTER_WORD = r"\p{L}{2,}"
HANGUL = r"[가-힣]"
DATE_LIKE = r"\d{4}[.\-]\d{2}[.\-]\d{2}|\d+\s*(시간|분|일)\s*전"
DATE_LIKE_ABSOLUTE = r"\d{4}[.\-]\d{2}[.\-]\d{2}"

# --- Fixed values: labels, thresholds and limits --------------------------
LABELS = ["negative", "neutral", "positive"]
SURGE, PLUNGE = "급등", "급락"
MISSING_TITLE = "제목없음"
REASON_NO_BODY = "본문 없음"
REASON_SHORT_BODY = "본문 짧음"
GATE_THRESHOLD = 0.6
REFINE_THRESHOLD = 0.7
LEXICON_MARGIN = 2
EVENT_THRESHOLD = 0.5
MIN_ARTICLES_PER_DAY = 5
LOOKBACK_DAYS = 30
BODY_PREFIX = 200
MODEL_TEXT_LIMIT = 512
MIN_TITLE, MIN_BODY_ELEMENT, MIN_BODY = 5, 30, 50
MAX_DATE_TEXT = 30
SAMPLE_QUOTAS = {"positive": 34, "negative": 33, "neutral": 33}
PAGES_PER_MONTH, PAGES_REALTIME, RESULTS_PER_PAGE = 40, 5, 10
EMPTY_PAGE_LIMIT, LAST_PAGE_WITHOUT_STOP = 3, 5
TARGET_ARTICLES, TARGET_FACTOR = 7000, 1.5
SCORER_BATCH = 16
