"""Catalogs: the word lists and patterns the operators are parameterised with.

Operators never name a skill, role, platform or portal themselves; they take
one of the objects below, so another market or language is another catalog.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These lists, names and patterns must equal the published ones
# for results to agree. They are data, in the order in which they are defined.
# ---------------------------------------------------------------------------

SKILL_NAMES = [
    # languages and frameworks
    "Python", "Java", "Spring Boot", "JavaScript", "TypeScript", "React", "Next.js",
    "Node.js", "Angular", "Vue.js", "FastAPI", "Django", "Flask", "C++", "C#",
    ".NET", "Golang", "Rust", "PHP", "Ruby", "HTML", "CSS", "Tailwind",
    # data
    "SQL", "PostgreSQL", "MySQL", "DuckDB", "MongoDB", "Redis", "Kafka",
    "Snowflake", "Databricks", "Spark", "Hadoop", "Airflow", "Pandas", "NumPy",
    "Tableau", "Power BI", "Excel", "dbt", "BigQuery",
    # machine learning
    "PyTorch", "TensorFlow", "scikit-learn", "Keras", "LangChain", "LlamaIndex",
    "RAG", "OpenCV", "Hugging Face", "NLP", "LLM",
    # cloud and operations
    "AWS", "GCP", "Azure", "Docker", "Kubernetes", "Terraform", "Ansible",
    "Jenkins", "CI/CD", "Linux", "Git", "Prometheus", "Grafana", "SRE",
    # interfaces, architecture, testing
    "REST API", "GraphQL", "Microservices", "Elasticsearch", "RabbitMQ", "Selenium",
]

# Alias bodies, matched between skill boundaries in any case.
SKILL_ALIASES = {
    "C++": r"C\+\+|cpp",
    "C#": r"C#|csharp|c[ -]sharp",
    ".NET": r"\.NET|dotnet",
    "Node.js": r"node\.?js|node",
    "React": r"react\.?js|react",
    "Next.js": r"next\.?js|next",
    "PostgreSQL": r"postgresql|postgres",
    "Kubernetes": r"kubernetes|k8s",
    "AWS": r"AWS|Amazon Web Services",
    "GCP": r"GCP|Google Cloud( Platform)?",
    "scikit-learn": r"scikit[ -]learn|sklearn",
    "Power BI": r"power\s*bi",
    "Spring Boot": r"spring\s*boot",
    "Golang": r"golang|go\s+language",
    "CI/CD": r"CI[/-]CD|cicd",
    "Excel": r"ms\s*excel|microsoft\s*excel|excel",
    "Microservices": r"microservices?",
    "REST API": r"REST(\s*APIs?)?|RESTful(\s*APIs?)?",
    "LLM": r"LLMs?",
}

# Short lower-case texts, one of which every match of the alias contains.
ALIAS_HINTS = {
    "C++": ["c++", "cpp"],
    "C#": ["c#", "csharp", "sharp"],
    ".NET": [".net", "dotnet"],
    "Node.js": ["node"],
    "React": ["react"],
    "Next.js": ["next"],
    "PostgreSQL": ["postgres"],
    "Kubernetes": ["kubernetes", "k8s"],
    "AWS": ["aws", "amazon web services"],
    "GCP": ["gcp", "google cloud"],
    "scikit-learn": ["scikit", "sklearn"],
    "Power BI": ["power"],
    "Spring Boot": ["spring"],
    "Golang": ["golang", "language"],
    "CI/CD": ["ci/cd", "ci-cd", "cicd"],
    "Excel": ["excel"],
    "Microservices": ["microservice"],
    "REST API": ["rest"],
    "LLM": ["llm"],
}

# The one acronym that is an English word too: exact case, or its long form.
ACRONYM_LONG_FORMS = {"RAG": r"retrieval[ -]augmented generation"}

# A skill may not touch one of these characters on either side.
SKILL_BOUNDARY_SET = "a-zA-Z0-9_#+"

ROLE_PATTERNS = {
    "backend": r"backend|back-end|python developer|java developer|software engineer|\bapis?\b|fastapi|django|flask",
    "data": r"data (engineer|analyst|scientist)|analytics|\betl\b|snowflake|\bbi\b",
    "ml_ai": r"machine learning|\bml\b|\bai\b|llm|nlp|deep learning|gen ?ai|\brag\b",
    "devops_cloud": r"devops|\bsre\b|site reliability|cloud|infrastructure|platform engineer",
    "frontend_fullstack": r"front-?end|full[ -]?stack|\breact(js)?\b|\bui\b",
}

ROLE_LABELS = {
    "backend": "Backend",
    "data": "Data",
    "ml_ai": "ML / AI",
    "devops_cloud": "DevOps & Cloud",
    "frontend_fullstack": "Frontend & Fullstack",
}

ROLE_PRIORITY = ["ml_ai", "data", "devops_cloud", "frontend_fullstack", "backend"]

PLATFORM_NAMES = ["LinkedIn", "Greenhouse", "Lever", "Workday", "Indeed", "Naukri"]
PLATFORM_FALLBACK = "Direct Portal"

# Apply-portal classes: (rank, words looked for in the link, words looked for in the title).
PORTAL_CLASSES = [
    (0, ["greenhouse.io", "lever.co", "workday", "smartrecruiters", "myworkdayjobs", "careers", "jobs."], []),
    (1, ["linkedin"], ["linkedin"]),
    (2, ["naukri", "indeed"], ["naukri"]),
    (4, ["shine", "jobmapp", "clickjobs", "timesjobs"], ["shine", "jobmapp", "clickjobs", "timesjobs"]),
]
PORTAL_DEFAULT_RANK = 3

RELATIVE_TIME_WORDS = ["just now", "yesterday", "today"]
RELATIVE_TIME_PATTERN = r"^\d+\s+(minute|hour|day|week|month)s?\s+ago$"
NON_SALARY_WORDS = [
    "full-time", "full–time", "part-time", "contract", "internship",
    "work from home", "onsite", "hybrid",
]
PAY_MARKER_PATTERN = r"(?:₹|INR|\bRs\.?\s*\d|\bLPA\b|\blakhs?\b|\b(a|per|/)\s*(year|annum|month|hour)\b)"
POSTED_AT_PATTERNS = [
    r"\b(?:hour|day|week|month|year)s?\s+ago\b",
    r"^\d+\s+(?:minute|hour|day|week|month|year)s?\s+ago$",
]

FOREIGN_CURRENCY_MARKS = ["$", "€", "£", "USD", "EUR", "GBP", "PLN"]
RUPEE_MARKS = ["₹", "inr", "rs", "lpa", "lakh", "lac", "l", "k"]

RESUME_SECTIONS = [
    r"\b(experience|work\s+experience|professional\s+experience|employment\s+history)\b",
    r"\b(education|academic\s+background|academics|qualifications|academic\s+profile)\b",
    r"\b(skills|technical\s+skills|core\s+competencies|technologies|proficiencies)\b",
    r"\b(projects|academic\s+projects|key\s+projects|personal\s+projects)\b",
    r"\b(certifications|certificates|licenses|courses|coursework)\b",
    r"\b(summary|professional\s+summary|profile|career\s+objective|objective)\b",
    r"\b(achievements|honors|awards|publications)\b",
]
RESUME_IDENTIFIERS_EXACT_CASE = [
    r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
]
RESUME_IDENTIFIERS = [
    r"\b(b\.?tech|b\.?e\.?|m\.?tech|mca|bca|b\.?sc|m\.?sc|bachelor|master|phd|diploma)\b",
    r"\b(developer|engineer|analyst|architect|consultant|programmer|intern|internship|specialist)\b",
    r"\b(university|institute|college|school|cgpa|gpa|percentage)\b",
]

DEFAULT_TITLE = "Untitled Role"
DEFAULT_COMPANY = "Unknown Company"
DEFAULT_VIA = "Direct"
DEFAULT_SCHEDULE = "Full-time"
DEFAULT_REGION = "in"
DEFAULT_LANGUAGE = "en"

CONSOLE_FORBIDDEN_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE",
    "ATTACH", "COPY", "PRAGMA", "EXPORT", "IMPORT", "SHOW",
    "LOAD", "INSTALL", "SET", "CALL", "EXECUTE",
]

CORPUS_NOTE = (
    "Jobs captured from Google Jobs searches in India using {n} distinct query phrases "
    "across several cities and remote. Not a random sample of the market."
)
EMPTY_EXPORT_MESSAGE = "No records found matching filters."

ZERO_WIDTH_CHARACTERS = "\u200b\u200c\u200d\ufeff"

# ------------------------------ end of fixed values ------------------------


def _lowered(body: str) -> str:
    """A pattern body in lower case, its escapes untouched, white space as wide as in text input."""
    lowered = re.sub(r"\\.|[A-Z]", lambda m: m.group() if m.group()[0] == "\\" else m.group().lower(), body)
    return lowered.replace(r"\s", r"[\s\x1c-\x1f]")


def _quoted(name: str) -> str:
    """A name matched literally, its spaces standing for any run of white space."""
    return r"\s+".join(re.escape(word) for word in name.split(" "))


@dataclass(frozen=True)
class Form:
    """One way a skill can be written.

    ``body`` is a regular expression without look-around; an any-case form is
    matched against case-folded text. ``hints`` are substrings of the folded
    text, one of which every match contains (none: no quick test). ``first`` is the
    character that every match begins with, where there is one: looked for before the edge is, which costs more.
    """

    body: str
    bounded: bool = True
    any_case: bool = True
    hints: tuple[str, ...] = ()
    first: str = ""

    @property
    def pattern(self) -> str:
        body = f"(?:{_lowered(self.body) if self.any_case else self.body})"
        if self.bounded:
            lead = f"(?={_lowered(re.escape(self.first)) if self.any_case else re.escape(self.first)})" if self.first else ""
            body = f"{lead}(?<![{SKILL_BOUNDARY_SET}]){body}(?![{SKILL_BOUNDARY_SET}])"
        return "(?U)" + body


@dataclass(frozen=True)
class SkillCatalog:
    """Canonical skill names in order, with the forms each may take in text."""

    names: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    long_forms: dict[str, str] = field(default_factory=dict)
    hints: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, names, aliases=None, long_forms=None, hints=None) -> "SkillCatalog":
        return cls(tuple(names), dict(aliases or {}), dict(long_forms or {}), dict(hints or {}))

    def is_acronym(self, name: str) -> bool:
        return name in self.long_forms

    def forms(self, name: str) -> list[Form]:
        own, first = (max(name.lower().split(" "), key=len),), name[:1].strip()
        if self.is_acronym(name):
            return [
                Form(_quoted(name), any_case=False, hints=own, first=first),
                Form(self.long_forms[name], bounded=False, hints=tuple(self.hints.get(name, ()))),
            ]
        if name in self.aliases:
            return [Form(self.aliases[name], hints=tuple(self.hints.get(name, ())))]
        return [Form(_quoted(name), hints=own, first=first)]

    def resolution_order(self) -> list[str]:
        """Names with a special pattern first (acronyms, then aliases), then the rest."""
        special = [*self.long_forms, *self.aliases]
        return special + [n for n in self.names if n not in special]


@dataclass(frozen=True)
class RoleCatalog:
    patterns: dict[str, str]
    priority: tuple[str, ...]
    labels: dict[str, str] = field(default_factory=dict)

    def regex(self, role: str) -> str:
        """Title pattern with ASCII word boundaries and case folding."""
        if role not in self.patterns:
            raise ValueError(f"no role is named {role}; there are {', '.join(sorted(self.patterns))}")
        word = "[0-9A-Za-z_]"
        edge = f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
        return "(?iu)" + self.patterns[role].replace(r"\b", edge)


SKILLS = SkillCatalog.of(SKILL_NAMES, SKILL_ALIASES, ACRONYM_LONG_FORMS, {**ALIAS_HINTS, "RAG": ["augmented generation"]})
ROLES = RoleCatalog(ROLE_PATTERNS, tuple(ROLE_PRIORITY), ROLE_LABELS)
