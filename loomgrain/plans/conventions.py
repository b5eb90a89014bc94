"""Path rules of the analyser. All patterns are fixed values; paths are root-relative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_NAME = r"\.(test|spec|e2e|bench|demo|example|story|stories|fixture|fixtures|mock|mocks)\.[mc]?[jt]sx?$|(^|/)((vitest|jest|playwright)[.-]?setup|setupTests|setup-tests|vitestSetup|jestSetup)\.[mc]?[jt]sx?$"
TEST_DIR = r"(?i)(^|/)(__[a-z0-9_-]+__|tests?|e2e|benches?|benchmarks?|perf-measures|playground|generated|gen)(/|$)"
GENERATED_NAME = r"\.(gen|generated|pb)\.[mc]?[jt]sx?$|_pb\.[mc]?[jt]sx?$"
GENERATED_MARKS = "@generated|auto-generated|autogenerated|do not edit|do not modify"
PUBLICATION = r"(?i)(^|/)(registry|styles|themes|variants|templates?|examples|presets|demos|icons|assets)/"
I18N = r"(?i)(^|/)(locales?|i18n|translations?|messages?|langs?|intl)(/|\.[mc]?[jt]sx?$)"
MIGRATIONS = r"(?i)(^|/)migrations?/"
LAYERED = r"(^|/)(dto|models?|views?|entity|entities|schemas?)/"
FRAMEWORK_FILE = r"(^|/)(app|pages|routes)/|(^|/)middleware\.|(^|/)instrumentation\.|\.config\.(ts|js|mjs|cjs)$"
ORPHAN_SKIP = (
    r"\.(test|spec|e2e|stories|story|bench|demo|example)\.[mc]?[jt]sx?$|\.d\.ts$|(^|/)tests?/|(^|/)__[a-zA-Z0-9_-]+__/|(^|/)e2e/|(^|/)fixtures?/|(^|/)benchmarks?/|(^|/)benches?/"
    r"|(^|/)examples?/|(^|/)playground/|(^|/)generated/|(^|/)gen/|(^|/)(perf|runtime|integration|smoke)(-(measures?|tests?|benchmarks?))?/|(^|/)vendor/"
)
SCAFFOLD_DIR = r"(^|/)components/ui$"

FRAMEWORK_PACKAGES = {
    "next": "next", "@sveltejs/kit": "sveltekit", "astro": "astro", "@remix-run/dev": "remix", "@remix-run/react": "remix", "@remix-run/node": "remix", "@remix-run/serve": "remix",
    "nuxt": "nuxt", "solid-start": "solid-start", "@solidjs/start": "solid-start", "@builder.io/qwik": "qwik", "@builder.io/qwik-city": "qwik",
}
_TOOLS = "postcss|tailwind|eslint|prettier|stylelint|babel|jest|vitest|playwright|cypress|webpack|rollup|esbuild|tsup|tsdown|drizzle|knip|biome|commitlint|lint-staged|markdoc|lunaria|panda|unocss|histoire|storybook|capacitor|electron-builder|expo|metro"
UNIVERSAL_ENTRIES = [
    r"(^|/)middleware\.(ts|js)$", r"(^|/)instrumentation\.(ts|js)$", r"(^|/)(next|vite|astro|svelte|nuxt|remix|vue)\.config\.(ts|js|mjs|cjs)$", rf"(^|/)({_TOOLS})\.config\.(ts|js|mjs|cjs)$",
    rf"(^|/)\.({_TOOLS})rc\.(ts|js|mjs|cjs|json)$", r"(^|/)src/index\.(ts|tsx|js|jsx|mjs)$", r"(^|/)src/(main|App)\.(ts|tsx|js|jsx|mjs)$", r"^index\.(ts|tsx|js|jsx|mjs)$",
]
FRAMEWORK_ENTRIES = {
    "next": [
        r"(^|/)app/(.+/)?(page|layout|route|loading|error|template|default|not-found|global-error|head|opengraph-image|twitter-image|icon|apple-icon|robots|sitemap|manifest)\.(ts|tsx|js|jsx)$",
        r"(^|/)pages/.+\.(ts|tsx|js|jsx)$",
    ],
    "sveltekit": [r"(^|/)src/routes/.*\+(page|layout|server|page\.server|layout\.server|error)\.(ts|js)$", r"(^|/)src/hooks\.(client|server)\.(ts|js)$", r"(^|/)src/service-worker\.(ts|js)$"],
    "astro": [r"(^|/)src/pages/.+\.(ts|js)$", r"(^|/)src/content/config\.(ts|js)$", r"(^|/)src/content\.config\.(ts|js)$", r"(^|/)src/middleware\.(ts|js)$", r"(^|/)astro\.config\.(ts|js|mjs|cjs)$"],
    "remix": [r"(^|/)app/root\.(tsx|jsx)$", r"(^|/)app/entry\.(client|server)\.(tsx|jsx|ts|js)$", r"(^|/)app/routes/.+\.(tsx|ts|jsx|js)$", r"(^|/)remix\.config\.(ts|js|mjs|cjs)$"],
    "nuxt": [r"(^|/)(pages|layouts)/.+\.(vue|ts|js)$", r"(^|/)(plugins|middleware|composables|server)/.+\.(ts|js)$", r"(^|/)app\.(vue|ts|js)$", r"(^|/)nuxt\.config\.(ts|js|mjs|cjs)$"],
    "solid-start": [r"(^|/)src/routes/.+\.(tsx|ts|jsx|js)$", r"(^|/)src/entry-(server|client)\.(tsx|ts|jsx|js)$", r"(^|/)src/root\.(tsx|ts|jsx|js)$"],
    "qwik": [r"(^|/)src/routes/.+\.(tsx|ts)$", r"(^|/)src/entry\.(ssr|dev|preview|cloudflare-pages|express|fastify)\.(tsx|ts)$", r"(^|/)src/root\.(tsx|ts)$"],
}
SCRIPT_RUNNER = r"\b(node|tsx|ts-node|tsm|vite-node|bun(?:\s+run)?|deno\s+run)\b"
SCRIPT_PATH = r"(?<!\S)((?:\./|\.\./|[A-Za-z0-9_.-]+/)[A-Za-z0-9_./-]+)(?=\s|['\"]|$)"
REGISTRY_PATH = r"(?:^|[\s,{])path\s*:\s*[\"']([^\"']+\.(?:tsx?|jsx?|mjs|cjs))[\"']"
PUBLISHED_NOT_SOURCE = r"(?i)\.(md|markdown|txt|json|yaml|yml|toml|lock|gitignore|npmignore)$"
ALIAS_TAIL = r"^[@~#$]/(.+)$"

_HTTP = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")
_APP = ("generateStaticParams", "generateMetadata", "generateViewport", "generateImageMetadata")
_PAGES = ("getStaticProps", "getStaticPaths", "getServerSideProps", "getInitialProps")


def is_test(rel: Column) -> Column:
    return rel.rlike(TEST_NAME) | rel.rlike(TEST_DIR)


def is_generated(rel: Column, text: Column) -> Column:
    return rel.rlike(GENERATED_NAME) | F.lower(F.substring(text, 1, 500)).rlike(GENERATED_MARKS)


def framework_function() -> Column:
    """Over ``functions``: called by the framework by its name and place, not by code."""
    rel, name = F.col("rel"), F.col("name")
    convention = r"(^|/)app/(.+/)?(route|opengraph-image|twitter-image|icon|apple-icon|sitemap|robots|manifest|head|page|layout|loading|error|template|default|not-found|global-error)\.(ts|tsx|js|jsx)$"
    page = rel.rlike(r"(^|/)pages/(.+)\.(ts|tsx|js|jsx)$")
    by_name = F.col("exported") & ((rel.rlike(r"(^|/)app/(.+/)?route\.(ts|tsx|js|jsx)$") & name.isin(*_HTTP)) | (rel.rlike(convention) & name.isin(*_APP)) | (page & name.isin(*_PAGES)) | F.col("server"))
    places = rel.rlike(convention) | rel.rlike(r"(^|/)pages/api/.+\.(ts|tsx|js|jsx)$") | rel.rlike(r"(^|/)(middleware|instrumentation|instrumentation-client)\.(ts|js|mjs|cjs)$")
    return F.coalesce(by_name | (F.col("is_default") & places), F.lit(False)) & F.col("form").isin("FunctionDeclaration", "ArrowFunction", "FunctionExpression")
