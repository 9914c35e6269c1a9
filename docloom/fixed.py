"""Names, word lists, patterns and limits that results must agree with.

Everything in this module is data that defines the extraction task; no logic lives here.
Patterns are meant case-insensitive unless said otherwise.
"""

# Output columns and the sentinel for what is unknown.
COLUMNS = ["pmcids", "conditions", "study_type", "sex", "minimum_age", "maximum_age", "eligibility_criteria"]
NOT_SPECIFIED = "Not Specified"

# Abbreviations that don't end a sentence.
ABBREVIATIONS = ["e.g", "i.e", "vs", "cf", "Dr", "Fig", "al", "no", "St", "Mr", "Ms", "approx", "Inc", "Ltd",
                 "etc", "ca", "Co", "Eq", "ref", "sd", "s.d", "i.v", "p.o"]

# Weighted patterns of interventional and of observational studies.
INTERVENTIONAL = [
    (r"\brandomi[sz]ed\b", 3), (r"\brandomly assigned\b", 3), (r"\bdouble[- ]blind\b", 3), (r"\bsingle[- ]blind\b", 2),
    (r"\bplacebo\b", 3), (r"\bclinical trial\b", 2), (r"\brct\b", 3), (r"\bphase\s+(?:i{1,3}|iv|[1-4])\b", 2),
    (r"\btreatment arm\b", 2), (r"\bintervention group\b", 2), (r"\ballocated\b", 1), (r"\bwere assigned\b", 1), (r"\bcrossover\b", 2)]
OBSERVATIONAL = [
    (r"\bretrospective", 3), (r"\bobservational\b", 3), (r"\bregistry\b", 2), (r"\bcohort study\b", 3), (r"\bcase[- ]control\b", 3),
    (r"\bcross[- ]sectional\b", 3), (r"\bcase report\b", 3), (r"\bcase series\b", 3), (r"\bchart review\b", 2),
    (r"\bmedical records?\b", 2), (r"\bconsecutive patients\b", 2), (r"\bprospectively (?:collected|enrolled|recruited)\b", 1),
    (r"\bnationwide\b", 1), (r"\breal[- ]world\b", 2), (r"\bdatabase\b", 1)]

# Words that tell the sex of a cohort.
FEMALE_CONDITIONS = ["breast", "cervical", "cervix", "ovarian", "ovary", "endometri", "uterine", "uterus", "vaginal", "vulva", "gynaecolog",
                     "gynecolog", "pregnan", "menopaus", "obstetric", "gestational", "preeclampsia", "eclampsia", "polycystic ovar"]
MALE_CONDITIONS = ["prostate", "prostatic", "testicular", "testis", "erectile", "penile", "benign prostatic"]
FEMALE_ONLY = ["women", "female patients", "only female", "exclusively female"]
MALE_ONLY = ["men", "male patients", "only male", "exclusively male"]
LOPSIDED = 3

# Ages.
PEDIATRIC = r"\b(p(a)?ediatric|children|infant|neonat|newborn)\b"
ADULT_AGE = "18 Years"
YEARS = r"(?:years?|yrs?|y(?:ears)?[- ]?old)"
AGE_RANGE = rf"\baged?\s+(\d{{1,3}})\s*(?:to|[-–—]|and|through)\s*(\d{{1,3}})\s*{YEARS}"
AGE_LEAST = rf"(?:≥|>=|at least|older than|over|aged?|minimum (?:age )?of)\s*(\d{{1,3}})\s*{YEARS}"
AGE_SPAN = rf"\b(\d{{1,3}})\s*[-–—]\s*(\d{{1,3}})\s*{YEARS}"
AGE_OR_OLDER = rf"\b(\d{{1,3}})\s*{YEARS}\s*(?:or older|and older|or above|and above|or more)"
ADULT = r"\badults?\b"
OLDEST = 120
AGE_MOST = rf"(?:≤|<=|up to|younger than|under|no older than|maximum (?:age )?of)\s*(\d{{1,3}})\s*{YEARS}"

# Section titles by purpose.
METHODS_TITLES = "method|material|patient|subject|particip|population|design|cohort|selection|enroll|inclus|exclus|eligib|recruit|study sample"
AGE_TITLES = "inclus|exclus|eligib|method|patient|particip"
CANDIDATE_TITLES = "inclus|exclus|eligib|selection criteria"
CONTEXT_TITLES = "inclus|exclus|eligib|selection criteria|patient|particip|method|population|cohort|enroll|recruit"
CRITERIA_TITLES = ["inclus", "exclus", "eligib|selection criteria"]
TITLE_NUMBER = r"^\s*[\dIVX]+(\.\d+)*[\.\)]\s*"
ABSTRACT_HEAD = r"^\s*abstract\b[:\s]*"
SKIPPED_ABSTRACTS = ["graphical", "teaser", "web-summary"]

# Cues of inclusion and exclusion in a sentence.
INCLUSION_CUES = (r"\b(included|enrolled|recruited|eligible|consecutive|underwent|diagnos(?:ed|is)|patients with|presenting with|aged|who had|"
                  r"confirmed|referred for|scheduled for|undergoing)\b")
EXCLUSION_CUES = (r"\b(exclud|were not|did not|without|absence of|contraindicat|unable to|refus(?:ed|al)|incomplete|missing data|lost to follow)\b")
AGE_HINTS = ["year", "age", "aged"]
PEOPLE_HINTS = ["patient", "subject"]
BULLET = r"^\s*[\*•\-–·]\s*|^\s*\(?\d+\)?[\.\)]\s*"

# Diseases.  DISEASE_SUFFIX is case-sensitive.
DISEASE_SUFFIX = (r"\b((?:[A-Z][A-Za-z'\-]+\s+){0,2}[A-Za-z'\-]*(?:cancer|carcinoma|tumou?r|neoplasm|disease|disorder|syndrome|deficiency|"
                  r"infection|injur(?:y|ies)|failure|stroke|fracture|itis|emia|oma|pathy|osis|aemia|trophy|plasia))\b")
DISEASE_WORDS = (r"\b(cancer|carcinoma|tumou?r|neoplasm|stroke|diabetes|hypertension|asthma|copd|pneumonia|sepsis|covid|sars-cov-2|influenza|"
                 r"tuberculosis|melanoma|leukemia|lymphoma|sarcoma|glioma|fibrosis|cirrhosis|hepatitis|arthritis|osteoporosis|alzheimer|"
                 r"parkinson|epilepsy|schizophrenia|depression|aneurysm|embolism|thrombosis|infarction|ischemia|hemorrhage|haemorrhage|"
                 r"fracture|osteoarthritis)\b")
CONDITION_LEADS = ["abstract", "background", "introduction", "method", "methods", "result", "results", "conclusion", "objective", "purpose", "aim",
                   "study", "related", "associated", "acute", "chronic", "the", "a", "an", "this", "these", "patient", "patients", "with", "and",
                   "or", "of", "for", "in", "underlying", "severe", "mild", "moderate", "primary", "secondary"]
CONDITION_GENERIC = ["disease", "disorder", "syndrome", "patient", "patients", "study", "control", "controls", "group", "groups", "case", "cases"]
CONDITION_BLOCKED = ["diagnosis", "prognosis", "analysis", "basis", "hypothesis", "emphasis", "synthesis", "consensus", "apoptosis", "homeostasis",
                     "genesis", "thesis", "stenosis diagnosis", "process", "purpose", "response", "release", "increase", "decrease", "disease",
                     "expertise", "exercise", "promise", "outcome", "genome", "syndrome", "chromosome", "ribosome", "dome", "biomass", "stroma",
                     "trauma", "schema", "comma", "gamma", "magma"]
CONDITION_JUNK = ["comparison", "reduction", "impact", "versus", "vs", "background", "automated", "manufacturing", "mapping", "precision", "towards",
                  "behind", "slides", "man", "analysis", "evaluation", "assessment", "using", "based", "imaging", "method", "approach", "study",
                  "trial", "efficacy", "accuracy", "feasibility", "role", "review", "case", "report", "series", "management", "outcome",
                  "outcomes", "detection", "diagnosis", "prediction", "characterization", "quantification"]

# Limits, bounds and prompts.
CONTEXT_CHARS, HARD_CHARS, NER_CHARS, METHODS_CHARS = 3000, 400, 6000, 2000
TRUNCATE_TARGET, TRUNCATE_EXTRA = 60, 130
SENTENCE_LEAST, SENTENCE_MOST = 15, 400
CANDIDATES, CRITERIA_EACH, CONDITIONS_FOUND, CONDITIONS_GENERATED = 60, 8, 3, 2
TOP_INCLUSION, TOP_EXCLUSION, LEAST_PROBABILITY, LEAST_SIMILARITY = 6, 5, 0.33, 0.45
CONDITION_PROMPT = "List the medical conditions/diseases studied in this article:\n"
ELIGIBILITY_PROMPT = "Generate the clinical trial eligibility criteria (inclusion and exclusion) for this study:\n"
EMBEDDING_SIZE = 768
