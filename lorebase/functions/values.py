"""Vocabularies, patterns and page skeletons that results depend on."""

# Fixed values follow, stated plainly in natural order.

SOURCE_TYPE_BY_SUFFIX = {
    "pdf": "journal_article", "docx": "other", "pptx": "presentation", "xlsx": "dataset",
    "html": "webpage", "htm": "webpage", "md": "personal_note", "txt": "personal_note",
}
TEXT_SUFFIXES = ["txt", "md", "html", "htm"]
#: Source types with the level of evidence each stands for.
EVIDENCE_BY_TYPE = {
    "journal_article": "peer_reviewed", "conference_paper": "conference", "preprint": "preprint",
    "government_report": "government_report", "research_institute_report": "research_institute_report",
    "industry_report": "industry_report", "news": "news", "webpage": "blog", "patent": "government_report",
    "dataset": "research_institute_report", "personal_note": "personal_note", "presentation": "industry_report",
    "blog": "blog", "other": "unknown",
}
EVIDENCE_BY_RANK = [
    "unknown", "personal_note", "blog", "news", "industry_report", "research_institute_report", "government_report",
    "preprint", "conference", "peer_reviewed",
]
PAGE_TYPES = ["papers", "concepts", "theories", "methods", "datasets", "researchers", "organizations", "technologies", "topics", "overviews", "questions"]
IDEA_KINDS = ["emerging", "research-questions", "hypotheses", "method-transfer", "domain-transfer", "rejected"]

CUES = {
    "purpose": [r"purpose of this (study|paper|research)", r"we (aim|seek) to", r"this (study|paper) (examines|investigates|explores)", r"목적으로\s*한다", r"목적은", r"목적이다"],
    "methodology": [r"\bmethodolog", r"\bmethods?\b", r"we (conducted|performed|used)", r"연구\s*방법", r"기법[을과]\s*(사용|활용)", r"(을|를)\s*(사용|활용)하여"],
    "research_questions": [r"research question", r"\bRQ\d?\b", r"we ask whether", r"연구\s*(질문|문제)\s*[:：\d]"],
    "sample": [
        r"\d[\d,]*\s*(명|건|개\s*기업|부)(?![가-힣]*\s*이상).*(수집|취합|응답|표본|사용자|대상)", r"(수집|취합|응답|표본|사용자|대상).*\d[\d,]*\s*(명|건)",
        r"\bN\s*=\s*\d", r"\d[\d,]*\s+(respondents|participants|professionals|firms|reviews|tweets)",
    ],
    "data": [r"수집하였다", r"데이터[는를].*(수집|취합)", r"data (were|was) collected"],
    "findings": [r"results? (show|indicate|suggest|reveal)", r"found that", r"we find", r"연구\s*결과", r"도출되었다", r"나타났다"],
    "theoretical_contrib": [r"theoretical contribution", r"contributes? to .*literature", r"학술적", r"학문적", r"이론적\s*(기여|시사점)", r"방법론적\s*확장"],
    "practical_contrib": [r"practical (implication|contribution)", r"managerial", r"실무적"],
    "limitations": [r"\blimitation", r"\bconstraint", r"한계", r"비교적\s*적", r"만을\s"],
    "future_work": [r"future (research|work|stud)", r"further (study|research|work)", r"should (examine|explore|investigate)", r"향후", r"후속\s*연구", r"추후", r"(으)?면\s.*수\s*있을\s*것이다"],
}

THEORIES = {
    "Expectancy-Disconfirmation Theory": [r"expectan\w*[\s-]*disconfirmation", r"기대\s*불일치"],
    "Technology Acceptance Model (TAM)": [r"technology\s+acceptance", r"기술\s*수용\s*모[델형]", r"\bTAM\b"],
    "UTAUT": [r"\bUTAUT2?\b", r"unified\s+theory\s+of\s+acceptance", r"통합\s*기술\s*수용"],
    "Theory of Planned Behavior (TPB)": [r"planned\s+behaviou?r", r"계획된\s*행동\s*이론"],
    "Diffusion of Innovations": [r"diffusion\s+of\s+innovations?", r"혁신\s*확산"],
    "Expectancy Theory": [r"(?<!disconfirmation )expectancy\s+theory", r"(?<!불일치 )기대\s*이론"],
    "Goal Theory": [r"goal(-setting)?\s+theory", r"목표\s*(설정\s*)?이론"],
    "Uses and Gratifications Theory": [r"uses\s+and\s+gratifications?", r"이용과\s*충족"],
    "Self-Determination Theory": [r"self[\s-]*determination\s+theory", r"자기\s*결정\s*이론"],
    "Two-Factor Theory": [r"two[\s-]*factor\s+theory", r"herzberg", r"2\s*요인\s*이론"],
}
METHODS = {
    "Joint Sentiment Topic Model (JST)": [r"joint\s*sentiment", r"\bJST\b"],
    "Latent Dirichlet Allocation (LDA)": [r"latent\s+dirichlet", r"\bLDA\b"],
    "BERTopic": [r"bertopic"],
    "Topic Modeling": [r"topic\s*model", r"토픽\s*모델"],
    "Text Mining": [r"text\s*mining", r"텍스트\s*마이닝"],
    "Sentiment Analysis": [r"sentiment\s+analysis", r"감성\s*분석"],
    "Keyword Network Analysis": [r"(keyword|semantic)\s+network", r"네트워크\s*(분석|다이어그램)"],
    "Morphological Analysis": [r"morphological\s+analysis", r"형태소\s*분석"],
    "Structural Equation Modeling (SEM)": [r"structural\s+equation", r"구조\s*방정식", r"\bSEM\b", r"\bPLS-SEM\b"],
    "Regression Analysis": [r"regression\s+analysis", r"회귀\s*분석"],
    "Latent Profile Analysis (LPA)": [r"latent\s+profile", r"잠재\s*프로파일", r"\bLPA\b"],
    "Survey": [r"\bsurvey\b", r"설문\s*조사"],
    "Interview": [r"\binterviews?\b", r"심층\s*면접", r"인터뷰"],
}

HEADING = r"^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\s*\.|[IVX]+\.\s|\d+(?:\.\d+)*\.?\s|\[|<표|<그림|〈|주제어|핵심어|key\s*words?\b|keywords\b|abstract\b|references\b|참고문헌|국내참고문헌)"
KOREAN_AUTHORS = r"^[가-힣]{2,4}(?:\s*[,，·ㆍ]\s*[가-힣]{2,4})+$"
JOURNAL = r"^\s*([A-Z][A-Za-z&\- ]{3,80}?),\s*\d+\s*\(\d+\)"
KEYWORDS = r"(?:주제어|핵심어|key\s*words?)\s*[:：]\s*(.+)"
KOREAN_ABSTRACT = r"(?:^|\n)\s*\[?\s*(?:요\s*약|국문\s*초록|초\s*록)\s*\]?\s*\n(.{40,4000}?)(?=\n\s*(?:주제어|핵심어|key\s*words?|Ⅰ\s*\.|1\.\s))"
ENGLISH_ABSTRACT = r"(?:^|\n)\s*abstract\b[:\s]*(.{40,4000}?)(?=\n\s*\n|\n\s*(?:key\s*words?|keywords|introduction|1\.\s)|\z)"
LIMITATION_HEADING = r"한계|limitation"
DOI = r"10\.\d{4,9}/[-._;()/:A-Z0-9]+"
YEAR = r"\b(?:19|20)\d{2}\b"
VOLUME_YEAR = r"제\s*\d+\s*권.*?((?:19|20)\d{2})\s*년"
NO_TITLE = r"https?://|doi|제\s*\d+\s*권|vol\.|©|@|^\W"
#: Borders and white space spelled out: in Java, marks belong to words, superscripts do not, and \s lacks \x1c-\x1f.
PHRASE = r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:[\s\x1c-\x1f]+[A-Z][a-z]+){1,3})(?![\p{L}\p{N}_])"
PHRASE_STOP = ["The", "This", "These", "We", "In", "Our"]
ORDINAL_PREFIX = r"^(첫째|둘째|셋째|넷째|다섯째|또한|아울러|그리고|따라서|즉|마지막으로|first(ly)?|second(ly)?|third(ly)?|also|finally|moreover)\s*,?\s*"
FUTURE_PREFIX = r"^(향후\s*연구에서는|future research)\s*"

SECTIONS = {
    "concepts": ["Definition", "Theoretical Origin", "Related Constructs", "Measurement", "Common Antecedents", "Common Outcomes", "Established Findings", "Conflicting Findings", "Boundary Conditions", "Applications", "Related Papers", "Open Questions"],
    "overviews": ["Current Understanding", "Major Theories", "Important Variables", "Established Findings", "Conflicting Findings", "Recent Developments", "Research Gaps", "Open Questions", "Key Papers"],
    "papers": ["Summary", "Research Context", "Research Design", "Variables", "Analysis", "Results", "Discussion", "Claims", "Related Pages", "Provenance"],
    "questions": ["Question", "Why It Is Open", "Related Concepts", "Related Papers", "Status"],
    "theories": ["Definition", "Core Propositions", "Key Constructs", "Applications", "Established Findings", "Conflicting Findings", "Related Papers", "Open Questions"],
    "methods": ["Description", "Typical Use Cases", "Evaluation Metrics", "Known Limitations", "Applications", "Related Papers"],
}
GENERIC_SECTIONS = ["Summary", "Related Pages", "Related Papers"]
CLAIM_ARROWS = {"positive": "→(+)", "negative": "→(-)", "none": "→(0)", "mixed": "→(±)", "unspecified": "→"}
SUMMARY_QUOTE = "> [!quote] 원문 요약 (Source Fact)\n> "
EXTRACTOR_LINE = "- Extractor: heuristic (rule-based) — 추출 항목은 원문 문장 그대로이며 검토 필요"
WHY_OPEN = "원 논문의 향후 연구 제안으로 언급됨 "
