"""Word lists, patterns and thresholds that results depend on."""

from __future__ import annotations

# Action verbs of each cognitive level, in the order of the taxonomy.
BLOOM_VERBS = {
    "Remember": ["define", "list", "state", "recall", "name", "identify", "label", "memorize", "recognize", "reproduce", "repeat", "mention"],
    "Understand": ["explain", "describe", "summarize", "classify", "interpret", "paraphrase", "discuss", "outline", "illustrate", "review", "clarify", "translate"],
    "Apply": ["implement", "use", "apply", "solve", "demonstrate", "execute", "operate", "compute", "calculate", "practice", "show", "produce"],
    "Analyze": ["compare", "differentiate", "analyze", "analyse", "examine", "distinguish", "contrast", "investigate", "break down", "deconstruct", "test", "categorize"],
    "Evaluate": ["justify", "assess", "evaluate", "judge", "critique", "argue", "defend", "recommend", "appraise", "rate", "select", "prioritize"],
    "Create": ["design", "develop", "create", "construct", "formulate", "generate", "plan", "compose", "build", "invent", "propose", "devise"],
}
#: Levels are tried from the highest down.
BLOOM_ORDER = ["Create", "Evaluate", "Analyze", "Apply", "Understand", "Remember"]
DIFFICULTY = {"Remember": "Easy", "Understand": "Easy", "Apply": "Medium", "Analyze": "Medium", "Evaluate": "Hard", "Create": "Hard", "Unknown": "Unknown"}

# Question forms, the first that matches decides. Matched as whole words, in any case.
WH_FORMS = [
    (r"why|why\s+is|why\s+are|why\s+do|why\s+does|why\s+should", "Evaluate"),
    (r"advantage|disadvantage|benefit|drawback|limitation|trade.?off|pros?\s+and\s+cons?", "Evaluate"),
    (r"difference|differences|differ|distinguish|compare|contrast|similarities|vs\.?|versus", "Analyze"),
    (r"how\s+does|how\s+do|how\s+is|how\s+are|how\s+can|how\s+to", "Analyze"),
    (r"what\s+are\s+the\s+(?:different\s+)?(?:types?|kinds?|forms?|categories|components?|elements?|phases?|stages?|steps?|parts?)", "Understand"),
    (r"brief(?:ly)?|short\s+note|outline|overview|concept\s+of", "Understand"),
    (r"what\s+is|what\s+are|what\s+was|what\s+were|what\s+do\s+you\s+mean", "Remember"),
    (r"who|when|where|which", "Remember"),
    (r"full\s+form|abbreviation|acronym|stand\s+for|meaning\s+of", "Remember"),
]

# Words that don't count as content of a chunk.
QUALITY_STOP_WORDS = [
    "the", "is", "are", "a", "an", "of", "in", "on", "to", "and", "or", "for", "with", "by", "as", "at", "from", "that", "this", "be", "was",
    "were", "it", "its", "into", "their", "there", "then", "has", "have", "had", "can", "will", "may", "which", "such", "etc", "i", "ii", "iii",
]

# Words of a question that name no concept.
GENERIC_WORDS = [
    "what", "is", "are", "was", "were", "can", "could", "should", "would", "will", "shall", "does", "do", "did", "has", "have", "had", "define",
    "explain", "describe", "analyze", "compare", "role", "purpose", "difference", "between", "how", "why", "the", "and", "for", "with", "about",
    "various", "concept", "concepts", "working", "principle", "principles", "importance", "advantages", "limitations", "disadvantages", "portal",
    "university", "systems", "system", "scenario", "case", "design", "implement", "evaluate", "justify", "meaning", "question", "differentiate",
    "contrast", "methods", "method", "approach", "approaches", "techniques", "technique", "analysis", "roles", "preventing", "unauthorized",
    "access", "prevent", "based", "using", "used", "implementation", "benefits", "drawbacks", "features", "feature", "applications", "application",
    "mechanisms", "mechanism", "authorities", "authority", "organizational", "introduction", "overview", "basics", "basic", "need", "module",
    "chapter", "unit", "study", "course", "applicable", "required", "syllabus", "topics", "together", "not required", "not",
]

# Domains that a syllabus has to name before a question may.
EXTERNAL_DOMAINS = [
    "blockchain", "cryptocurrency", "ethereum", "kubernetes", "docker", "cnn", "convolutional neural network", "deep learning",
    "recommendation engine", "recommender system", "hadoop", "cloud-native", "devops", "malware detection", "neural network", "microservices",
    "smart contract", "pod security", "wallets",
]

# Markers of question types (substrings), and words left out of core terms.
APPLICATION_MARKERS = ["case study", "scenario", "analyze", "how would you", "design", "implement", "evaluate", "justify", "compare"]
DEFINITION_MARKERS = ["what is", "define", "explain", "describe", "short note", "meaning of", "overview of"]
#: NLTK's English stop words, without those that no word of three letters can be.
KEYWORD_STOP_WORDS = (
    "myself our ours ourselves you your yours yourself yourselves him his himself she her hers herself its itself they them their theirs themselves what which who whom this that these those are was were been being "
    "have has had having does did doing the and but because until while for with about against between into through during before after above below from down out off over under again further then once here there "
    "when where why how all any both each few more most other some such nor not only own same than too very can will just don should now ain aren couldn didn doesn hadn hasn haven isn mightn mustn needn shan shouldn "
    "wasn weren won wouldn"
).split()
#: scikit-learn's English stop words.
TFIDF_STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at "
    "back be became because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do "
    "done down due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found "
    "four from front full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself "
    "keep last latter latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not "
    "nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should "
    "show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore "
    "therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two un under until up upon us very via was we well were what "
    "whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself "
    "yourselves"
).split()
CORE_STOP_WORDS = ["what", "is", "the", "of", "and", "in", "to", "explain", "define", "describe", "how"]

# Department names by abbreviation; abbreviations known without a longer name stay as they are.
DEPARTMENTS = {
    "IT": "Information Technology", "CS": "Computer Science and Engineering", "CSE": "Computer Science and Engineering", "EE": "Electrical Engineering",
    "ECE": "Electronics and Communication Engineering", "ME": "Mechanical Engineering", "CE": "Civil Engineering",
}
DEPARTMENT_CODES = ["IT", "CS", "CSE", "EE", "ECE", "ME", "CE", "MCA", "BCA", "MBA"]

# Patterns of the gates. Publisher names have no word bounds, so parts of longer words count too.
PUBLISHERS = r"Publishing|Publishers?|Press|Edition|McGraw|Pearson|Wiley|Springer|Elsevier|Oxford|Cambridge|Prentice|Tata|Jaico|Housing"
PUBLISHER_CODES = ["PHI", "EPH", "TMH", "SPD", "BPB"]
SYLLABUS_SIGNS = r"Overview|Definition|Introduction|Concept|Architecture|Protocol|Mechanism|Technique|Algorithm|Application|Type[s]?|Model[s]?|Security|Management|System|Design|Analysis|Method"
EDUCATIONAL = (
    r"introduc(?:tion|ing|ed)|overview|concept|principle|theor(?:y|ies)|algorithm|protocol|architecture|mechanism|technique|method(?:ology)?|"
    r"application|implementation|design|analysis|comparison|evaluation|type[s]?|categor(?:y|ies)|classif(?:y|ication)|"
    r"defin(?:e|ition)|explain|describ(?:e|ing)|understand|demonstrate|compar(?:e|ison)|contrast|discuss|illustrat(?:e|ing)|analyz(?:e|ing)|"
    r"model|framework|structure|component|system|network|database|encrypt(?:ion)?|decrypt(?:ion)?|secur(?:ity|e)|"
    r"program(?:ming)?|software|hardware|process(?:ing)?|memory|storage|communication|transmission|function|operation|procedure|workflow|pipeline"
)
HEADER_START = (
    r"Subject\s*Name\s*[:\-]|Course\s*Title\s*[:\-]|Subject\s*Code\s*[:\-]|Paper\s*Code\s*[:\-]|Course\s*Code\s*[:\-]|Code\s*[:\-]\s*[A-Z0-9]+|"
    r"Contact\s*(?:Hrs?)?\s*[:\-]|Credits?\s*[:\-]|L\s*[-–]\s*T\s*[-–]\s*P\s*[:\-]|L-T-P|Semester\s*[:\-]|Total\s*Marks?\s*[:\-]|"
    r"Internal\s*(?:Assessment|Marks?)\s*[:\-]|External\s*(?:Assessment|Marks?|Exam)\s*[:\-]|End\s*Semester\s*Exam|Mid\s*Semester|"
    r"Teaching\s*Scheme|Examination\s*Scheme|Credit\s*Points?|Hours?\s*/\s*Week|Pre-?requisite\s*[:\-]|Category\s*[:\-]|Department\s*[:\-]|"
    r"Faculty\s*[:\-]|University\s*[:\-]"
)
HEADER_LINE = (
    r"(?:Subject|Course|Paper|Code)\s*(?:Name|Title|Code)?\s*[:\-]|(?:Credits?|Contacts?|L-T-P|Hours?|Marks?)\s*[:\-]?|"
    r"(?:Internal|External|Total)\s*(?:Assessment|Marks?|Exam)\s*[:\-]?|(?:Semester|Department|Faculty|University)\s*[:\-]?|"
    r"Teaching\s*Scheme|Examination\s*Scheme|Credit\s*Points?"
)
COURSE_META = (
    r"Teaching Scheme|Examination Scheme|Maximum Marks|Credit Points?|Mid Semester|End Semester Exam|Assignment and Quiz|Theory:\s*\d+\s*hrs?|"
    r"Tutorial:\s*\d+\s*L|Practical:\s*(?:NIL|\d+)|Duration:\s*\d+\s*months?|Name of the Course:|Course Code:|Contacts:\s*\d+\s*L|Hrs/Unit|Marks/Unit|"
    r"Syllabus\s*and\s*Curricular\s*Mapping(?:forB\.Tech)?|Effective\s*from\s*Acdemic\s*Session|University\s*Syllabus:?"
)
LEGACY_META = (
    r"Teaching\s*Scheme|Examination\s*Scheme|Maximum\s*Marks|Credit\s*Points?|Mid\s*Semester|End\s*Semester\s*Exam|Hrs/Unit|Marks/Unit|"
    r"Theory:\s*\d+|Tutorial:\s*\d+|Practical:\s*(?:NIL|\d+)|Duration:\s*\d+|Internal\s*Assessment"
)
ACCREDITATION = r"NBA|NAAC|Accreditat|Programme Outcome|PO\d+\s*:|Bloom.{0,20}Level|Attainment|Mapping.*CO|CO.*Mapping|CO-PO|PO-CO"
UNIVERSITY = r"University\s*of\s*Technology|Formerly\s*West\s*Bengal|Syllabus\s*and\s*Curricular"
LEGACY_UNIVERSITY = r"University\s*of\s*Technology|Maulana|Formerly\s*West\s*Bengal|Syllabus\s*and\s*Curricular\s*Mapping"
REFERENCE_HEADING = r"(?:\d+\.?\s*)?(?:Text\s*books?|References?|Reference\s*books?|Suggested\s*Readings?|Bibliography)(?:\s*and\s*reference\s*books?)?\s*:?"
TITLE_MARKER = r"(?:Course\s*Title|Course\s*Name|Paper\s*Title|Subject\s*Title)\s*[:\-]"
STRUCTURED_SIGNS = [
    r"Course\s*Outcomes?", r"CO\s*-\s*PO\s*Mapping", r"CO\s*-?\s*PO", r"Course\s*Objectives?", r"Course\s*Title", r"Program\s*Outcomes?", r"\bPSO\b",
    r"Syllabus\s*and\s*Curricular\s*Mapping", r"Mapping\s*of\s*COs", r"Course\s*Articulation\s*Matrix", r"Bloom\s*['s]*\s*Taxonomy",
]
FORMAT_SIGNS = ["course objectives", "course outcomes", "co-po mapping", "syllabus and curricular mapping", "program outcomes", "pso", "course articulation matrix"]

# Elective kinds in the order of the scan.
ELECTIVES = [
    ("PEC", r"\bP(?:rofessional\s*)?E(?:lective)?\s*C(?:ourse)?\b|\bPEC\b"), ("OEC", r"\bO(?:pen)?\s*E(?:lective)?\s*C(?:ourse)?\b|\bOEC\b|\bOE\b"),
    ("HSS", r"\bHumanities?\b|\bSocial\s*Science\b|\bHSS\b"), ("LAB", r"\bLab(?:oratory)?\b|\bPractical\b"), ("PROJ", r"\bProject\b|\bThesis\b|\bDissertation\b"),
]

# Metadata fields and their patterns, the first that gives a value decides.
METADATA = {
    "subject_name": [r"Subject\s*Name\s*[:\-]\s*(.+)", r"Name\s*of\s*the\s*Subject\s*[:\-]\s*(.+)", r"Course\s*Title\s*[:\-]\s*(.+)", r"(?:^|\n)([A-Z\s]{5,60})(?:\n|$)"],
    "subject_code": [r"Subject\s*Code\s*[:\-]\s*([\w\-/]+)", r"Paper\s*Code\s*[:\-]\s*([\w\-/]+)", r"Code\s*[:\-]\s*([\w\-/]+)"],
    "semester": [r"Semester\s*[:\-]\s*(\d+|[IVXLC]+)", r"([\d\w]+)\s*Semester"],
    "program": [r"Program\s*[:\-]\s*(.+)", r"Course\s*[:\-]\s*(B\.Tech|M\.Tech|BCA|MCA|BBA|MBA|B\.Sc|M\.Sc)"],
    "department": [r"Department\s*[:\-]\s*(.+)", r"Dept\.\s*[:\-]\s*(.+)"],
    "bos": [r"Board\s*of\s*Studies\s*[:\-]\s*(.+)", r"BOS\s*[:\-]\s*(.+)"],
}
#: What every match of those patterns holds, in lower case.
METADATA_HELD = {"subject_name": ["name", "subject", "title", ""], "subject_code": ["code"] * 3, "semester": ["semester"] * 2, "program": ["program", "course"], "department": ["department", "dept."], "bos": ["studies", "bos"]}
