"""What a caller can find out about a base: its format, how it is taken in, searched and checked, the presets, and the tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.functions.constants import MIN_SCORE, MODE_FIELDS, MODE_PURPOSE, MODES, SECTION_WORDS, SPARSE_WORDS, SUBDIRS

VERSION = "0.2.0"

EXAMPLE = "\n".join(
    ["---", 'title: "A title"', "type: concept", "aliases: []", "tags: [one, two]", 'sources: ["daily/2026-05-01.md"]', "created: 2026-05-01"]
    + ["updated: 2026-05-01", "source_version: 1", "ingest_date: 2026-05-01", 'historical_context: "Compiled from daily log 2026-05-01.md"', "---"]
)


def rules() -> dict[str, object]:
    check = lambda name, severity, what: {"name": name, "severity": severity, "description": what}
    tool = lambda name, signature, what: {"tool": name, "signature": signature, "purpose": what}
    return {
        "package": "quern",
        "version": VERSION,
        "description": "a base of markdown articles, compiled, checked and searched with Spark",
        "kb_schema": {
            "artifact_format": {
                "description": "an article is a markdown file with frontmatter, right in one of the folders",
                "subdirs": SUBDIRS,
                "frontmatter_fields": {
                    "required": ["title"],
                    "recommended": ["type", "tags", "sources", "created", "updated"],
                    "versioning": ["source_version", "ingest_date", "historical_context"],
                },
                "article_types": ["concept", "mechanism", "outcome", "reference", "connection"],
                "example": EXAMPLE,
            },
            "ingestion": {
                "description": "articles pass a quality gate into the snapshot of the base",
                "detection": "by time first, then by hash",
                "state_file": "ingest_state",
                "quality_gating": {
                    "description": "each article is scored and held against the thresholds of the mode",
                    "score_criteria": [f"{c}: 0.2" for c in ("a title", "tags", "sources", "a body of 100 words", "a link in the body")],
                    "rejection_reasons": ["fewer words than min_words_reject", "a required key is missing", "a score of reject_quality_score or less"],
                },
                "compilation": {
                    "description": "sections of daily logs become articles",
                    "input": "logs/*.md",
                    "output": "{folder}/{slug}.md",
                    "section_min_words": SECTION_WORDS,
                    "state_file": "compile_state",
                },
            },
            "search": {
                "engine": "TF-IDF",
                "caching": "index",
                "version_filtering": "min_version and max_version of query, both inclusive",
                "fallback": f"the articles updated last, where the best score is under {MIN_SCORE}",
            },
            "validation": {
                "description": "six checks that need no model",
                "checks": [
                    check("broken_links", "error", "a link without a target"),
                    check("orphan_pages", "warning", "no link names the article by its path"),
                    check("orphan_sources", "warning", "no article refers to the log"),
                    check("stale_articles", "warning", "the log changed after it was compiled"),
                    check("missing_backlinks", "suggestion", "the target of a link doesn't link back"),
                    check("sparse_articles", "suggestion", f"fewer than {SPARSE_WORDS} words"),
                ],
            },
        },
        "modes": [{"name": m, "description": MODE_PURPOSE[m], **dict(zip(MODE_FIELDS, v))} for m, v in MODES.items()],
        "env_vars": [
            {"name": "QUERN_PROJECT_ROOT", "purpose": "the folder that the other folders are in", "default": "the working folder"},
            {"name": "QUERN_KB_DIR", "purpose": "the folder of the base", "default": "kb in the project root"},
        ],
        "tools": [
            tool("set_mode", "(mode)", "choose a preset"),
            tool("get_mode", "()", "the preset in force, its thresholds, and all presets"),
            tool("ingest", "(force_all=False, dry_run=False)", "take in new and changed articles"),
            tool("compile", "(all_logs=False, file=None, dry_run=False)", "daily logs into articles"),
            tool("query", "(question, top_k=5, min_version=None, max_version=None)", "search"),
            tool("validate", "()", "all checks"),
            tool("status", "()", "what is new, stale or gone, and how many issues"),
            tool("scan_prototypes", "(scan_dir=None, output_file=None)", "rank project folders"),
            tool("get_shortlist", "(shortlist_path=None, domain=None, min_priority=None)", "read a ranking"),
            tool("get_rules", "()", "these rules"),
        ],
    }


def flat(node: object, path: str = "") -> list[tuple[str, str]]:
    """(path, value) of each leaf; list places count from 0."""
    if isinstance(node, dict):
        return [x for k, v in node.items() for x in flat(v, f"{path}.{k}" if path else k)]
    if isinstance(node, list):
        return [x for k, v in enumerate(node) for x in flat(v, f"{path}[{k}]")]
    return [(path, str(node))]


def table(spark: SparkSession) -> DataFrame:
    """(path, value)."""
    return spark.createDataFrame(flat(rules()), "path string, value string")
