"""Word lists, thresholds and cut-offs that results depend on."""

REF_DATE = "2026-06-10"
REF_YEAR, REF_MONTH = 2026, 6

IT_SERVICES = ["tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant", "capgemini", "hcl", "hcl technologies", "tech mahindra", "mphasis", "hexaware", "ltimindtree", "mindtree", "persistent", "persistent systems", "coforge", "birlasoft", "niit technologies", "l&t infotech", "lti", "mastech", "kpit", "sonata software"]
CORE_SKILLS = ["embeddings", "retrieval", "vector", "ranking", "search", "sentence-transformers", "sentence_transformers", "faiss", "elasticsearch", "pinecone", "weaviate", "ndcg", "evaluation", "a/b", "python", "llm", "fine-tuning", "finetuning", "lora", "recommendation", "nlp", "ir", "information retrieval"]
NICE_SKILLS = ["xgboost", "learning-to-rank", "ltr", "distributed systems", "inference optimization", "open source", "hr tech", "recruitment", "qdrant", "milvus", "opensearch"]
CITIES = ["pune", "noida", "hyderabad", "mumbai", "delhi", "bangalore", "bengaluru", "gurgaon", "gurugram"]
PRODUCTION = ["deployed", "deploy", "productionized", "shipped", "ship", "scaled", "scale", "served", "serving", "production", "prod", "users", "latency", "throughput", "real-time", "realtime", "live", "live traffic", "a/b test", "a/b tested", "rollout", "launched", "in production", "at scale", "millions", "billion", "qps", "rps", "uptime", "reliability", "serving infrastructure"]
TIER_SCORE = {"tier_1": 4, "tier_2": 3, "tier_3": 2, "tier_4": 1}
STEM = ["computer science", "cs", "cse", "information technology", "it", "electronics", "ece", "electrical", "eee", "mathematics", "statistics", "physics", "data science", "machine learning", "artificial intelligence", "ai", "ml", "information systems", "software engineering", "software"]
SIZE_ORDINAL = {"1-10": 1, "11-50": 2, "51-200": 3, "201-500": 4, "501-1000": 5, "1001-5000": 6, "5001-10000": 7, "10001+": 8}
STARTUP_SIZES = ["1-10", "11-50", "51-200"]
ROLE_WORDS = ["ml", "machine learning", "ai", "artificial intelligence", "nlp", "deep learning", "llm", "retrieval", "ranking", "recommendation", "embeddings", "vector", "search", "data scientist", "research", "engineer", "senior"]
BEHAVIOURAL = ["recency_score", "open_to_work", "recruiter_response_rate", "interview_completion_rate", "applications_30d", "profile_completeness", "saved_by_recruiters_30d", "verified_contact", "behavioral_composite"]
RUBRIC = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
SWEEP = [10, 15, 20, 25, 30, 35, 40, 50]
QUOTA = 20
#: The quotas of the labelling sample, in the order of drawing.
QUOTAS = {"top_retrieval_bm25": 200, "top_retrieval_dense": 200, "top_anti_persona_sim": 150, "title_match_strong": 200, "title_mismatch": 150, "consulting_only": 100, "honeypot_flagged": 100, "high_behavioral": 150, "low_behavioral": 150, "tier1_education": 100, "random": 1000}

# BM25 and fusion constants of the common Okapi formula.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
# Query over the documents table; one word occurs twice and so counts twice, one is in no document.
QUERY = ["candidate", "search", "ranking", "search", "the", "zzzunknown", "experience"]

# Stated query texts of the candidate funnel: those wanted first, then those not wanted; the first stands for the whole.
WANTED_TEXTS = [
    "engineer who shipped search ranking and retrieval systems to production for many users",
    "machine learning engineer with embeddings, vector search and evaluation of ranking quality",
    "data scientist who built recommendation models and measured them in live experiments",
    "backend engineer who scaled low latency services and data pipelines in python",
    "researcher in natural language processing who deployed language models",
]
UNWANTED_TEXTS = [
    "marketing manager responsible for campaigns and brand communication",
    "sales representative for regional accounts and customer visits",
    "mechanical engineer for plant maintenance and equipment design",
    "human resources generalist for payroll and staff records",
    "accountant for invoices, audits and financial reports",
]
#: Words that make a title match, and the likeness from which another title is a mismatch worth a look.
TITLE_WORDS, MISMATCH_FROM = ["engineer", "ml", "ai", "scientist", "research"], 0.3
#: Lengths of the pools that are cut from an order.
POOL_TOP = {"top_retrieval_bm25": 500, "top_retrieval_dense": 500, "top_anti_persona_sim": 300, "high_behavioral": 300, "low_behavioral": 300}
#: Rows that a reranker sees, and rows of the final ranking.
RERANKED, FINAL = 200, 100
INVENTED_COMPANIES = ["pied piper", "initech", "wayne enterprises", "stark industries", "dunder mifflin", "umbrella corporation", "soylent", "globex", "hooli", "acme corp"]
