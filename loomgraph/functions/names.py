"""Known technologies and aliases, as small tables to join or test against."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by which an entity is known to be a technology.
TECHNOLOGIES = (
    "Python", "JavaScript", "TypeScript", "Java", "Go", "Rust", "C", "C++", "C#", "Ruby", "Kotlin", "Swift", "Scala", "R",
    "MATLAB", "Julia", "Haskell", "Erlang", "Elixir", "PHP", "Perl", "Bash", "PowerShell", "React", "Vue", "Angular",
    "Svelte", "Next.js", "Nuxt", "Remix", "FastAPI", "Django", "Flask", "Express", "NestJS", "Spring Boot", "Rails",
    "Laravel", "ASP.NET", "PostgreSQL", "MySQL", "SQLite", "MongoDB", "Redis", "Cassandra", "DynamoDB", "Elasticsearch",
    "InfluxDB", "CockroachDB", "Neo4j", "ChromaDB", "Pinecone", "Weaviate", "Qdrant", "Milvus", "Docker", "Kubernetes",
    "Helm", "Podman", "Containerd", "AWS", "GCP", "Azure", "Vercel", "Netlify", "Render", "Heroku", "Cloudflare",
    "DigitalOcean", "Fly.io", "Terraform", "Ansible", "GitHub Actions", "Jenkins", "GitLab CI", "CircleCI", "ArgoCD",
    "Pulumi", "TensorFlow", "PyTorch", "scikit-learn", "Keras", "JAX", "Hugging Face", "LangChain", "LlamaIndex",
    "Sentence Transformers", "spaCy", "NLTK", "OpenCV", "Pandas", "NumPy", "SciPy", "Matplotlib", "Plotly", "Kafka",
    "RabbitMQ", "Celery", "Redis Streams", "NATS", "ZeroMQ", "REST", "GraphQL", "gRPC", "WebSockets", "HTTP", "HTTPS",
    "OAuth", "JWT", "OpenAPI", "Swagger", "Prometheus", "Grafana", "Datadog", "Sentry", "OpenTelemetry", "Jaeger",
    "Zipkin", "npm", "yarn", "pnpm", "pip", "Poetry", "Hatch", "Cargo", "Maven", "Gradle", "Webpack", "Vite", "esbuild",
    "Rollup", "Git", "GitHub", "GitLab", "Bitbucket", "Linux", "Ubuntu", "Debian", "Alpine", "macOS", "Windows", "Nginx",
    "Apache", "Caddy", "HAProxy", "S3", "GCS", "Azure Blob", "MinIO", "TCP", "UDP", "DNS", "TLS", "SSL", "SSH",
)
# Other names of one entity, and the name it goes by.
ALIASES = {
    "k8s": "kubernetes", "kube": "kubernetes", "js": "javascript", "ts": "typescript", "py": "python",
    "postgres": "postgresql", "pg": "postgresql", "mongo": "mongodb", "amazon web services": "aws", "amazon s3": "s3",
    "amazon rds": "postgresql", "google cloud platform": "gcp", "google cloud": "gcp", "microsoft azure": "azure",
    "gh actions": "github actions", "github action": "github actions", "reactjs": "react", "react.js": "react",
    "nodejs": "node.js", "node": "node.js", "nextjs": "next.js", "hf": "hugging face", "transformers": "hugging face",
    "sklearn": "scikit-learn", "sbert": "sentence transformers", "docker-compose": "docker", "docker compose": "docker",
    "celerybeat": "celery", "celery beat": "celery",
}


def plain_slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


TECHNOLOGY_SLUGS = sorted({plain_slug(t) for t in TECHNOLOGIES})
ALIAS_SLUGS = {plain_slug(a): plain_slug(b) for a, b in ALIASES.items()}


def is_technology(slugged: Column) -> Column:
    return slugged.isin(TECHNOLOGY_SLUGS)


def resolve_alias(slugged: Column, aliases: dict[str, str] | None = None) -> Column:
    """The slug an entity goes by; its own where it has no alias."""
    pairs = [F.lit(x) for item in (aliases or ALIAS_SLUGS).items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), slugged), slugged)
