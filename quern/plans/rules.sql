SELECT * FROM (VALUES
('package', 'quern'),
('version', '0.2.0'),
('description', 'a base of markdown articles, compiled, checked and searched with Spark'),
('kb_schema.artifact_format.description', 'an article is a markdown file with frontmatter, right in one of the folders'),
('kb_schema.artifact_format.subdirs[0]', 'concepts'),
('kb_schema.artifact_format.subdirs[1]', 'connections'),
('kb_schema.artifact_format.subdirs[2]', 'mechanisms'),
('kb_schema.artifact_format.subdirs[3]', 'outcomes'),
('kb_schema.artifact_format.subdirs[4]', 'references'),
('kb_schema.artifact_format.frontmatter_fields.required[0]', 'title'),
('kb_schema.artifact_format.frontmatter_fields.recommended[0]', 'type'),
('kb_schema.artifact_format.frontmatter_fields.recommended[1]', 'tags'),
('kb_schema.artifact_format.frontmatter_fields.recommended[2]', 'sources'),
('kb_schema.artifact_format.frontmatter_fields.recommended[3]', 'created'),
('kb_schema.artifact_format.frontmatter_fields.recommended[4]', 'updated'),
('kb_schema.artifact_format.frontmatter_fields.versioning[0]', 'source_version'),
('kb_schema.artifact_format.frontmatter_fields.versioning[1]', 'ingest_date'),
('kb_schema.artifact_format.frontmatter_fields.versioning[2]', 'historical_context'),
('kb_schema.artifact_format.article_types[0]', 'concept'),
('kb_schema.artifact_format.article_types[1]', 'mechanism'),
('kb_schema.artifact_format.article_types[2]', 'outcome'),
('kb_schema.artifact_format.article_types[3]', 'reference'),
('kb_schema.artifact_format.article_types[4]', 'connection'),
('kb_schema.artifact_format.example', '---
title: "A title"
type: concept
aliases: []
tags: [one, two]
sources: ["daily/2026-05-01.md"]
created: 2026-05-01
updated: 2026-05-01
source_version: 1
ingest_date: 2026-05-01
historical_context: "Compiled from daily log 2026-05-01.md"
---'),
('kb_schema.ingestion.description', 'articles pass a quality gate into the snapshot of the base'),
('kb_schema.ingestion.detection', 'by time first, then by hash'),
('kb_schema.ingestion.state_file', 'ingest_state'),
('kb_schema.ingestion.quality_gating.description', 'each article is scored and held against the thresholds of the mode'),
('kb_schema.ingestion.quality_gating.score_criteria[0]', 'a title: 0.2'),
('kb_schema.ingestion.quality_gating.score_criteria[1]', 'tags: 0.2'),
('kb_schema.ingestion.quality_gating.score_criteria[2]', 'sources: 0.2'),
('kb_schema.ingestion.quality_gating.score_criteria[3]', 'a body of 100 words: 0.2'),
('kb_schema.ingestion.quality_gating.score_criteria[4]', 'a link in the body: 0.2'),
('kb_schema.ingestion.quality_gating.rejection_reasons[0]', 'fewer words than min_words_reject'),
('kb_schema.ingestion.quality_gating.rejection_reasons[1]', 'a required key is missing'),
('kb_schema.ingestion.quality_gating.rejection_reasons[2]', 'a score of reject_quality_score or less'),
('kb_schema.ingestion.compilation.description', 'sections of daily logs become articles'),
('kb_schema.ingestion.compilation.input', 'logs/*.md'),
('kb_schema.ingestion.compilation.output', '{folder}/{slug}.md'),
('kb_schema.ingestion.compilation.section_min_words', '50'),
('kb_schema.ingestion.compilation.state_file', 'compile_state'),
('kb_schema.search.engine', 'TF-IDF'),
('kb_schema.search.caching', 'index'),
('kb_schema.search.version_filtering', 'min_version and max_version of query, both inclusive'),
('kb_schema.search.fallback', 'the articles updated last, where the best score is under 0.1'),
('kb_schema.validation.description', 'six checks that need no model'),
('kb_schema.validation.checks[0].name', 'broken_links'),
('kb_schema.validation.checks[0].severity', 'error'),
('kb_schema.validation.checks[0].description', 'a link without a target'),
('kb_schema.validation.checks[1].name', 'orphan_pages'),
('kb_schema.validation.checks[1].severity', 'warning'),
('kb_schema.validation.checks[1].description', 'no link names the article by its path'),
('kb_schema.validation.checks[2].name', 'orphan_sources'),
('kb_schema.validation.checks[2].severity', 'warning'),
('kb_schema.validation.checks[2].description', 'no article refers to the log'),
('kb_schema.validation.checks[3].name', 'stale_articles'),
('kb_schema.validation.checks[3].severity', 'warning'),
('kb_schema.validation.checks[3].description', 'the log changed after it was compiled'),
('kb_schema.validation.checks[4].name', 'missing_backlinks'),
('kb_schema.validation.checks[4].severity', 'suggestion'),
('kb_schema.validation.checks[4].description', 'the target of a link doesn''t link back'),
('kb_schema.validation.checks[5].name', 'sparse_articles'),
('kb_schema.validation.checks[5].severity', 'suggestion'),
('kb_schema.validation.checks[5].description', 'fewer than 50 words'),
('modes[0].name', 'developer'),
('modes[0].description', 'everyday work'),
('modes[0].min_words', '50'),
('modes[0].min_words_reject', '10'),
('modes[0].min_frontmatter_fields', '2'),
('modes[0].required_frontmatter[0]', 'title'),
('modes[0].min_quality_score', '0.2'),
('modes[0].reject_quality_score', '0.0'),
('modes[1].name', 'research'),
('modes[1].description', 'lenient, for notes still being explored'),
('modes[1].min_words', '30'),
('modes[1].min_words_reject', '5'),
('modes[1].min_frontmatter_fields', '1'),
('modes[1].required_frontmatter[0]', 'title'),
('modes[1].min_quality_score', '0.1'),
('modes[1].reject_quality_score', '0.0'),
('modes[2].name', 'review'),
('modes[2].description', 'strict, before something is published'),
('modes[2].min_words', '100'),
('modes[2].min_words_reject', '20'),
('modes[2].min_frontmatter_fields', '4'),
('modes[2].required_frontmatter[0]', 'title'),
('modes[2].required_frontmatter[1]', 'type'),
('modes[2].required_frontmatter[2]', 'tags'),
('modes[2].min_quality_score', '0.4'),
('modes[2].reject_quality_score', '0.1'),
('modes[3].name', 'ops'),
('modes[3].description', 'for running systems'),
('modes[3].min_words', '30'),
('modes[3].min_words_reject', '5'),
('modes[3].min_frontmatter_fields', '2'),
('modes[3].required_frontmatter[0]', 'title'),
('modes[3].min_quality_score', '0.2'),
('modes[3].reject_quality_score', '0.0'),
('modes[4].name', 'personal'),
('modes[4].description', 'permissive, for a journal'),
('modes[4].min_words', '10'),
('modes[4].min_words_reject', '1'),
('modes[4].min_frontmatter_fields', '1'),
('modes[4].required_frontmatter[0]', 'title'),
('modes[4].min_quality_score', '0.0'),
('modes[4].reject_quality_score', '0.0'),
('env_vars[0].name', 'QUERN_PROJECT_ROOT'),
('env_vars[0].purpose', 'the folder that the other folders are in'),
('env_vars[0].default', 'the working folder'),
('env_vars[1].name', 'QUERN_KB_DIR'),
('env_vars[1].purpose', 'the folder of the base'),
('env_vars[1].default', 'kb in the project root'),
('tools[0].tool', 'set_mode'),
('tools[0].signature', '(mode)'),
('tools[0].purpose', 'choose a preset'),
('tools[1].tool', 'get_mode'),
('tools[1].signature', '()'),
('tools[1].purpose', 'the preset in force, its thresholds, and all presets'),
('tools[2].tool', 'ingest'),
('tools[2].signature', '(force_all=False, dry_run=False)'),
('tools[2].purpose', 'take in new and changed articles'),
('tools[3].tool', 'compile'),
('tools[3].signature', '(all_logs=False, file=None, dry_run=False)'),
('tools[3].purpose', 'daily logs into articles'),
('tools[4].tool', 'query'),
('tools[4].signature', '(question, top_k=5, min_version=None, max_version=None)'),
('tools[4].purpose', 'search'),
('tools[5].tool', 'validate'),
('tools[5].signature', '()'),
('tools[5].purpose', 'all checks'),
('tools[6].tool', 'status'),
('tools[6].signature', '()'),
('tools[6].purpose', 'what is new, stale or gone, and how many issues'),
('tools[7].tool', 'scan_prototypes'),
('tools[7].signature', '(scan_dir=None, output_file=None)'),
('tools[7].purpose', 'rank project folders'),
('tools[8].tool', 'get_shortlist'),
('tools[8].signature', '(shortlist_path=None, domain=None, min_priority=None)'),
('tools[8].purpose', 'read a ranking'),
('tools[9].tool', 'get_rules'),
('tools[9].signature', '()'),
('tools[9].purpose', 'these rules')
) v(path, value)
