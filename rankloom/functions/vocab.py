"""Word lists. Results depend on every term, and blanks at the ends count."""

# Fixed values, first ranker: matched as substrings of lower-cased text.
A_CONSULTING = ["accenture", "capgemini", "cognizant", "hcl", "infosys", "l&t infotech", "ltimindtree", "mindtree", "mphasis", "tata consultancy services", "tcs", "tech mahindra", "wipro"]
A_RETRIEVAL = ["elasticsearch", "embedding", "embeddings", "faiss", "hybrid search", "information retrieval", "milvus", "opensearch", "pinecone", "qdrant", "rag", "ranking", "recommendation system", "recommender", "retrieval", "semantic search", "vector database", "vector search", "weaviate"]
A_EVALUATION = ["a/b test", "ab test", "evaluation framework", "map@", "mean average precision", "mrr", "ndcg", "offline evaluation", "precision@", "recall@"]
A_VISION_SPEECH = ["autonomous navigation", "computer vision", "image classification", "image segmentation", "object detection", "robotics", "slam", "speech recognition"]
A_LANGUAGE = ["information retrieval", "language model", "named entity recognition", "natural language processing", "nlp", "text classification", "text mining", "topic modeling"]
A_LEAD_TITLES = ["architect", "director", "engineering manager", "head of", "tech lead", "vp "]
A_PRODUCTION = ["at scale", "deployed", "launched", "live system", "production", "real users", "real-time", "shipped"]
A_RESEARCH = ["academic research", "phd thesis", "postdoc", "research lab", "university research"]
A_HIRING = ["candidate screening", "hiring platform", "hr tech", "job matching", "marketplace", "recruiting", "recruitment", "talent acquisition"]
A_OPEN_SOURCE = ["blog post", "conference talk", "github.com", "open source", "open-source", "published", "research paper"]
A_CODING = ["built", "coded", "developed", "implemented", "shipped", "wrote"]
A_RECENT_AI = A_RETRIEVAL + [" ml ", "ai ", "machine learning"]

# Fixed values, second ranker.
B_EMBEDDING = ["dense retrieval", "embeddings", "rag", "semantic search", "sentence transformers"]
B_PRODUCTION = ["deployed", "infrastructure", "production", "scale", "users"]
B_VECTOR_STORE = ["chroma", "chromadb", "elasticsearch", "faiss", "hybrid search", "milvus", "opensearch", "pinecone", "qdrant", "weaviate"]
B_EVALUATION = ["a/b test", "ab test", "evaluation", "experimentation", "map", "mrr", "ndcg", "precision", "recall"]
B_PLACES = ["ahmedabad", "bangalore", "bengaluru", "chennai", "delhi", "gurgaon", "hyderabad", "india", "kolkata", "mumbai", "ncr", "noida", "pune"]
B_HIRING = ["applicant tracking", "ats", "hiring", "hr tech", "hr-tech", "job board", "marketplace", "matching", "recruiting", "talent"]
B_OPEN_SOURCE = ["arxiv", "conference", "open source", "open-source", "papers", "patent", "published", "talks"]
B_ACADEMIC_TITLES = ["academic", "fellow", "phd", "postdoc", "professor", "researcher", "student"]
B_LLM = ["gpt", "langchain", "llamaindex", "llm", "openai"]
B_CLASSIC = ["classification", "keras", "machine learning", "numpy", "pandas", "pytorch", "regression", "scikit-learn", "sklearn", "tensorflow", "xgboost"]
B_LEAD_TITLES = ["architect", "director", "head", "lead", "manager", "vp"]
B_CODING = ["c++", "code", "coded", "develop", "hands-on", "implement", "java", "python", "scala", "write", "writing"]
B_CONSULTING = ["accenture", "capgemini", "cognizant", "hcl", "infosys", "l&t", "lnt", "mindtree", "mphasis", "tcs", "tech mahindra", "wipro"]
B_VISION_SPEECH = ["asr", "audio", "cnn", "computer vision", "image", "object detection", "opencv", "robotics", "ros", "speech", "tts", "yolo"]
B_LANGUAGE = ["bert", "bm25", "elastic", "embeddings", "gpt", "information retrieval", "ir", "language", "nlp", "qdrant", "ranking", "retrieval", "search", "text", "transformers"]
B_RELEVANT_ROLES = ["ai", "computer vision", "data science", "data scientist", "deep learning", "llm", "machine learning", "ml", "natural language", "nlp", "ranking", "retrieval", "search"]

# What may stand for a required skill.
MUST_HAVE = {
    "embeddings-based retrieval systems": ["bge", "dense retrieval", "e5", "embeddings", "embeddings-based retrieval systems", "information retrieval", "rag", "retrieval", "semantic search", "sentence transformers", "vector embeddings", "vector search"],
    "vector databases": ["chroma", "chromadb", "elasticsearch", "faiss", "milvus", "opensearch", "pinecone", "qdrant", "vector database", "vector databases", "weaviate"],
    "hybrid search infrastructure": ["bm25", "elasticsearch", "hybrid search", "hybrid search infrastructure", "information retrieval", "lucene", "opensearch", "retrieval", "solr"],
    "python": ["python"],
    "evaluation frameworks for ranking systems": ["a/b test", "a/b testing", "evaluation", "evaluation frameworks for ranking systems", "experimentation", "learning to rank", "map", "mrr", "ndcg", "precision", "ranking", "recall", "recommendation systems"],
}

# Names of skills, and what a skill implies.
ALIASES = {
    "python": ["py", "python", "python3"],
    "fastapi": ["fast api", "fastapi"],
    "sql": ["postgres", "postgresql", "sql", "sqlite"],
    "qdrant": ["qdrant", "vector database", "vector db"],
    "machine learning": ["machine learning", "ml"],
    "data engineering": ["data engineering", "data pipelines", "etl"],
    "react": ["react", "react.js", "reactjs"],
}
IMPLIES = {"fastapi": ["python"], "postgresql": ["sql"], "sqlite": ["sql"], "qdrant": ["vector database"], "machine learning": ["python"], "data engineering": ["python", "sql"]}

# Lines that open a section.
HEADINGS = {
    "summary": ["about", "objective", "profile", "summary"],
    "skills": ["skills", "technical skills", "technologies", "tooling"],
    "experience": ["career history", "employment history", "experience", "professional experience", "work experience"],
    "education": ["academic background", "education"],
    "projects": ["projects", "selected projects"],
    "certifications": ["certificates", "certifications"],
}

# Permitted values of record fields.
COMPANY_SIZES = ["1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+"]
PROFICIENCIES = ["beginner", "intermediate", "advanced", "expert"]
EDUCATION_TIERS = ["tier_1", "tier_2", "tier_3", "tier_4", "unknown"]
WORK_MODES = ["remote", "hybrid", "onsite", "flexible"]
LANGUAGE_LEVELS = ["basic", "conversational", "professional", "native"]
