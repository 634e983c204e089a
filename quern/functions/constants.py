"""Fixed tables of the engine: stop words, folders, modes, project indicators."""

STOP_WORDS = (
    "a i be he me we if of am an in on do go no so to up or as is us at it by my had did and see she the one are use all him "
    "can who two her for our has was his its get not but out you new how now day say way any good make take like time come "
    "some were have give with back look work well will them from than been then when even also into year over your does this "
    "that what want most just know they only could would there these being doing which think other after their first about "
    "people having because "
).split()

SUBDIRS = "concepts connections mechanisms outcomes references".split()

#: mode: (min_words, min_words_reject, min_fields, required, min_score, reject_score)
MODES = {
    "developer": (50, 10, 2, ["title"], 0.2, 0.0),
    "research": (30, 5, 1, ["title"], 0.1, 0.0),
    "review": (100, 20, 4, ["title", "type", "tags"], 0.4, 0.1),
    "ops": (30, 5, 2, ["title"], 0.2, 0.0),
    "personal": (10, 1, 1, ["title"], 0.0, 0.0),
}
MODE_FIELDS = ["min_words", "min_words_reject", "min_frontmatter_fields", "required_frontmatter", "min_quality_score", "reject_quality_score"]
MODE_PURPOSE = {
    "developer": "everyday work",
    "research": "lenient, for notes still being explored",
    "review": "strict, before something is published",
    "ops": "for running systems",
    "personal": "permissive, for a journal",
}

MIN_SCORE = 0.1
TOP_K = 5
CONTEXT_CHARS = 8000
SECTION_WORDS = 50
SPARSE_WORDS = 50
KEY_POINTS = 5
#: Of a scan: projects, text files of each, files of them in which topics are sought, bytes of a file that is read, that is
#: searched for topics, and of a README, and characters of it.
PROJECTS, TEXT_FILES, TOPIC_FILES = 50, 200, 100
TREE_BYTES, TOPIC_BYTES, README_BYTES, README_CHARS = 50_000, 10_000, 2000, 500

#: In the order that breaks ties.
DOMAINS = {
    "ai-ml": "agent|deep learning|embedding|fine-tuning|inference|language model|llm|machine learning|neural network|ollama|prompt engineering|rag|rlhf|training|transformer".split("|"),
    "neuroscience": "action selection|amygdala|basal ganglia|brain|cognitive|cortex|dopamine|evidence accumulation|hippocampus|neuron|prefrontal|reward prediction|synapse".split("|"),
    "knowledge-management": "compilation|cross-reference|frontmatter|indexing|ingest|knowledge base|markdown|semantic search|tf-idf|wiki".split("|"),
    "dev-tools": "build|ci|cli|deploy|extension|format|hook|lint|mcp|package|plugin|test|tool".split("|"),
    "data-engineering": "batch|cache|database|etl|event|message bus|pipeline|queue|storage|streaming".split("|"),
}
MATURITY = {
    "production": ".github/workflows|CHANGELOG.md|CONTRIBUTING.md|Dockerfile|SECURITY.md|ci.yml|docker-compose.yml".split("|"),
    "beta": "_test.py|conftest.py|pyproject.toml|test_|tests/".split("|"),
    "alpha": "README.md|requirements.txt|setup.py".split("|"),
    "prototype": ".ipynb|experiment|prototype|scratch".split("|"),
}
STACK = {
    "python": "Pipfile|pyproject.toml|requirements.txt|setup.py".split("|"),
    "javascript": "package.json".split("|"),
    "typescript": "tsconfig.json".split("|"),
    "rust": "Cargo.toml".split("|"),
    "go": "go.mod".split("|"),
    "c/c++": "CMakeLists.txt|Makefile".split("|"),
    "docker": "Dockerfile|docker-compose.yml".split("|"),
}
MARKERS = "Cargo.toml|Makefile|README.md|go.mod|package.json|pyproject.toml|requirements.txt|setup.py".split("|")
SUFFIXES = ".bash .cfg .css .dockerfile .go .html .ini .ipynb .js .json .md .py .rs .sh .toml .ts .txt .yaml .yml .zsh".split()
READMES = ["README" + end for end in (".md", ".txt", ".rst", "")]
