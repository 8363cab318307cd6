"""Fixed values and tunables of the pipeline."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

# Sections of a profile and of a crawled site, in output order, with their labels.
PROFILE_SECTIONS = {"biography": "Biography", "research_interests": "Research interests", "education": "Education", "areas_of_interest": "Areas of interest", "labs_and_groups": "Labs and groups", "projects": "Projects"}
SITE_SECTIONS = {"website_summary": "Website summary", "current_projects": "Current projects", "recent_publications": "Recent publications", "students_or_lab_members": "Students and lab members", "recent_news": "Recent news"}
# Words that make a link of a home page worth following.
LINK_WORDS = ("research", "publication", "publications", "bio", "about", "project", "projects", "group", "lab", "labs", "people", "students", "news", "cv")
# Fixed value: the answer when nothing is known.
NO_ANSWER = "I don't have that information in my data."
#: What the generator is told before the context.
ANSWER_RULES = "Answer from the numbered context alone and in two or three sentences. Cite each fact by its number in brackets, as in [1]. If several people or pages fit, name them all. If the context does not hold the answer, reply: " + NO_ANSWER
#: What the extractor is told before the text of a site.
EXTRACT_RULES = "Read the text of a personal or lab web site and give a JSON object with the fields website_summary (two to four sentences), current_projects, recent_publications (titles, with the year if given), students_or_lab_members and recent_news (with dates). Use only what the text says; leave a field empty if it says nothing."


@dataclass(frozen=True)
class Settings:
    """Limits of the jobs; every operator takes the one it needs as a parameter."""

    schema_version: str = "v1"
    top_k: int = 8
    dimension: int = 1024
    pages_per_site: int = 5
    least_text: int = 200
    most_text: int = 20_000
    embed_batch: int = 64
    write_batch: int = 100
    retries: int = 6
    first_delay: float = 2.0
    longest_delay: float = 60.0
    question_length: tuple[int, int] = (2, 2000)
    preview_rows: int = 3
    preview_chars: int = 300
    agent: str = "quarrymill"
    timeout: float = 30.0
    delay: float = 1.0
    extract_pause: float = 4.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "QUARRYMILL_") -> "Settings":
        """The defaults with what the environment sets, such as QUARRYMILL_TOP_K; the question length is two numbers with a comma."""
        given = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if env.get(prefix + f.name.upper())}
        kinds = {"int": int, "float": float, "str": str, "tuple[int, int]": lambda x: tuple(int(n) for n in x.split(","))}
        of = {f.name: f.type if isinstance(f.type, str) else f.type.__name__ for f in fields(cls)}
        return replace(cls(), **{k: kinds.get(of[k], kinds["tuple[int, int]"])(v) for k, v in given.items()})


def require(*names: str, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """The values of settings that must be there; one error names all that are missing."""
    missing = [n for n in names if not env.get(n)]
    if missing:
        raise RuntimeError("missing settings: " + ", ".join(missing))
    return {n: env[n] for n in names}


SETTINGS = Settings()
