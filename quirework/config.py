"""Settings, languages and the layout of a work folder."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from .operators.segment import Chunking

# Language codes and names.
LANGUAGES = {
    "ja": "Japanese", "en": "English", "zh": "Chinese", "ko": "Korean", "fr": "French", "de": "German", "es": "Spanish", "pt": "Portuguese", "ru": "Russian", "it": "Italian", "ar": "Arabic",
    "th": "Thai", "vi": "Vietnamese", "id": "Indonesian", "ms": "Malay", "pl": "Polish", "tr": "Turkish", "uk": "Ukrainian", "nl": "Dutch", "sv": "Swedish", "cs": "Czech", "ro": "Romanian",
    "hu": "Hungarian", "el": "Greek", "he": "Hebrew", "hi": "Hindi", "bn": "Bengali", "ta": "Tamil", "fi": "Finnish", "da": "Danish", "no": "Norwegian",
}
CATEGORIES = ("character", "place", "organization", "item", "technique", "term")
STAGES = ("extract", "clean", "classify", "chunk", "glossary_build", "glossary_cluster", "glossary_reconcile", "translate", "assemble", "rebuild")


def language_name(code: str) -> str:
    """The language's name; an unknown code is its own name."""
    return LANGUAGES.get(code, code)


@dataclass(frozen=True)
class Batching:
    target: int = 8000
    least: int = 1000
    redistribute: float = 0.4


@dataclass(frozen=True)
class Clustering:
    rounds: int = 3
    jw_threshold: float = 0.75
    pairs_per_call: int = 10
    auto_merge: bool = False
    embeddings: bool = False
    candidate_cosine: float = 0.55
    auto_cosine: float = 0.82
    low_cosine: float = 0.50


@dataclass(frozen=True)
class Translation:
    summary_budget: int = 2000
    qa_retries: int = 3
    shortest: float = 0.3
    longest: float = 2.0
    overlap: bool = True
    across_documents: bool = True


@dataclass(frozen=True)
class Models:
    """Names of models by task; a task without one takes the translating model."""

    translate: str = ""
    summarize: str | None = None
    qa: str | None = None

    def of(self, task: str) -> str:
        return getattr(self, task) or self.translate


@dataclass(frozen=True)
class Settings:
    source_language: str = "ja"
    target_language: str = "en"
    categories: tuple[str, ...] = CATEGORIES
    title_suffix: str | None = None
    chunking: Chunking = field(default_factory=Chunking)
    batching: Batching = field(default_factory=Batching)
    clustering: Clustering = field(default_factory=Clustering)
    translation: Translation = field(default_factory=Translation)
    models: Models = field(default_factory=Models)
    toc_categories: tuple[str, ...] = ()
    stylesheet: str = "added.css"

    def suffix(self) -> str:
        return f" ({language_name(self.target_language)} Translation)" if self.title_suffix is None else self.title_suffix


def merged(base, given: dict):
    """Settings with what ``given`` (as read from YAML or JSON) names; unknown names are ignored."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    changes = {k: merged(known[k], v) if is_dataclass(known[k]) else tuple(v) if isinstance(known[k], tuple) else v for k, v in given.items() if k in known}
    return replace(base, **changes)


def load(path: str) -> Settings:
    """Settings of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return merged(Settings(), yaml.safe_load(f) or {})


def default_yaml() -> str:
    import yaml

    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else list(v) if isinstance(v, tuple) else v
    return yaml.safe_dump(plain(asdict(Settings())), sort_keys=False, allow_unicode=True)


@dataclass(frozen=True)
class Layout:
    """Paths of the tables of a run: one folder a stage and version, never changed once written."""

    root: str

    def stage(self, stage: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"no stage {stage}")
        return f"{self.root.rstrip('/')}/{stage}"

    def table(self, stage: str, version: int = 0) -> str:
        return f"{self.stage(stage)}/v={version}"

    def log(self) -> str:
        return f"{self.root.rstrip('/')}/state"
