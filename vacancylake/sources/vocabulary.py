"""Built-in term dictionaries.

Each dictionary maps group -> term -> (subcategory, aliases).  Every built-in
term has weight 1.0.  Other dictionaries can be read from JSON files, see
``sources.dictionaries``.
"""

from __future__ import annotations

from typing import NamedTuple

TERM_WEIGHT = 1.0

# The terms and aliases the matchers must recognise.

SKILLS = {
    "programming_languages": {
        "python": ("programming", ["py", "python3", "python2"]),
        "java": ("programming", ["jvm", "java se", "java ee"]),
        "javascript": ("programming", ["js", "ecmascript", "es6", "es2015", "node.js", "nodejs"]),
        "typescript": ("programming", ["ts"]),
        "c++": ("programming", ["cpp", "c plus plus", "cplusplus"]),
        "c#": ("programming", ["csharp", "c sharp", ".net"]),
        "php": ("programming", ["php7", "php8"]),
        "ruby": ("programming", ["rb"]),
        "go": ("programming", ["golang"]),
        "rust": ("programming", []),
        "swift": ("programming", []),
        "kotlin": ("programming", []),
        "scala": ("programming", []),
        "r": ("programming", ["r programming", "r language"]),
        "matlab": ("programming", []),
        "sql": ("database", ["structured query language", "mysql", "postgresql", "tsql"]),
    },
    "data_science": {
        "machine learning": ("ai", ["ml", "machinelearning", "machine-learning"]),
        "deep learning": ("ai", ["dl", "neural networks", "deep neural networks", "dnn"]),
        "artificial intelligence": ("ai", ["ai", "artificial-intelligence"]),
        "natural language processing": ("ai", ["nlp", "natural-language-processing", "text processing"]),
        "computer vision": ("ai", ["cv", "image processing", "image recognition"]),
        "data analysis": ("analysis", ["data analytics", "data-analysis"]),
        "statistics": ("analysis", ["statistical analysis", "stats"]),
        "big data": ("data", ["bigdata", "big-data"]),
        "data mining": ("data", ["datamining", "data-mining"]),
        "predictive modeling": ("modeling", ["predictive analytics", "forecasting"]),
        "data visualization": ("visualization", ["data viz", "dataviz", "charts", "graphs"]),
        "business intelligence": ("analysis", ["bi", "business analytics"]),
    },
    "libraries_frameworks": {
        "pandas": ("data", []),
        "numpy": ("data", []),
        "scikit-learn": ("ml", ["sklearn", "scikit learn"]),
        "tensorflow": ("ml", ["tf"]),
        "pytorch": ("ml", ["torch"]),
        "keras": ("ml", []),
        "matplotlib": ("visualization", []),
        "seaborn": ("visualization", []),
        "plotly": ("visualization", []),
        "spacy": ("nlp", []),
        "nltk": ("nlp", ["natural language toolkit"]),
    },
}

TECHNOLOGIES = {
    "frameworks": {
        "react": ("frontend", ["reactjs", "react.js", "react js"]),
        "angular": ("frontend", ["angularjs", "angular2", "angular 2"]),
        "vue": ("frontend", ["vuejs", "vue.js", "vue js"]),
        "django": ("backend", ["django framework"]),
        "flask": ("backend", ["flask framework"]),
        "spring": ("backend", ["spring boot", "spring framework"]),
        "express": ("backend", ["expressjs", "express.js", "express js"]),
        "laravel": ("backend", ["laravel framework"]),
        "rails": ("backend", ["ruby on rails", "ror"]),
        "fastapi": ("backend", ["fast api"]),
        "nextjs": ("fullstack", ["next.js", "next js"]),
        "nuxtjs": ("fullstack", ["nuxt.js", "nuxt js"]),
    },
    "databases": {
        "mysql": ("relational", ["my sql"]),
        "postgresql": ("relational", ["postgres", "psql"]),
        "mongodb": ("nosql", ["mongo", "mongo db"]),
        "redis": ("cache", []),
        "elasticsearch": ("search", ["elastic search", "elastic"]),
        "cassandra": ("nosql", ["apache cassandra"]),
        "oracle": ("relational", ["oracle db", "oracle database"]),
        "sqlite": ("relational", ["sqlite3"]),
        "dynamodb": ("nosql", ["dynamo db", "amazon dynamodb"]),
        "firebase": ("nosql", ["google firebase"]),
    },
    "cloud_platforms": {
        "aws": ("cloud", ["amazon web services", "amazon aws"]),
        "azure": ("cloud", ["microsoft azure", "azure cloud"]),
        "gcp": ("cloud", ["google cloud platform", "google cloud", "gcloud"]),
        "docker": ("containerization", ["docker containers"]),
        "kubernetes": ("orchestration", ["k8s", "k8"]),
        "terraform": ("infrastructure", ["terraform iac"]),
        "ansible": ("automation", []),
        "jenkins": ("ci_cd", []),
        "gitlab": ("ci_cd", ["gitlab ci", "gitlab ci/cd"]),
        "github actions": ("ci_cd", ["github action"]),
    },
    "tools_platforms": {
        "git": ("version_control", ["github", "gitlab", "version control"]),
        "jira": ("project_management", ["atlassian jira"]),
        "confluence": ("documentation", ["atlassian confluence"]),
        "slack": ("communication", []),
        "tableau": ("visualization", []),
        "powerbi": ("visualization", ["power bi", "microsoft powerbi"]),
        "vs code": ("ide", ["vscode", "visual studio code"]),
        "intellij": ("ide", ["intellij idea", "jetbrains intellij"]),
        "postman": ("api_testing", []),
        "figma": ("design", []),
    },
    "operating_systems": {
        "linux": ("os", ["ubuntu", "centos", "debian", "redhat"]),
        "windows": ("os", ["microsoft windows", "windows server"]),
        "macos": ("os", ["mac os", "osx", "os x"]),
        "unix": ("os", []),
    },
}

EXTENDED_TECHNOLOGIES = {
    "programming_languages": {
        "python": ("programming_language", ["py", "python3", "python2"]),
        "javascript": ("programming_language", ["js", "javascript", "ecmascript", "node.js", "nodejs"]),
        "java": ("programming_language", ["jdk", "jvm", "java se", "java ee"]),
        "c#": ("programming_language", ["csharp", "c sharp", ".net", "dotnet"]),
        "php": ("programming_language", ["php7", "php8", "laravel", "symfony"]),
        "go": ("programming_language", ["golang", "go lang"]),
        "rust": ("programming_language", ["rust-lang"]),
        "swift": ("programming_language", ["swift ui", "swiftui"]),
        "kotlin": ("programming_language", ["kt"]),
        "typescript": ("programming_language", ["ts", "type script"]),
    },
    "frameworks": {
        "react": ("frontend_framework", ["reactjs", "react.js", "react native", "reactnative"]),
        "angular": ("frontend_framework", ["angularjs", "angular.js", "angular2+"]),
        "vue": ("frontend_framework", ["vuejs", "vue.js", "vue3"]),
        "django": ("backend_framework", ["django rest", "drf"]),
        "flask": ("backend_framework", ["flask-restful"]),
        "spring": ("backend_framework", ["spring boot", "springboot", "spring mvc"]),
        "express": ("backend_framework", ["expressjs", "express.js"]),
        "laravel": ("backend_framework", ["laravel 8", "laravel 9", "laravel 10"]),
    },
    "databases": {
        "mysql": ("relational_database", ["mysql 5", "mysql 8", "mariadb"]),
        "postgresql": ("relational_database", ["postgres", "psql"]),
        "mongodb": ("nosql_database", ["mongo", "mongo db"]),
        "redis": ("cache_database", ["redis cache"]),
        "elasticsearch": ("search_database", ["elastic search", "es"]),
        "oracle": ("relational_database", ["oracle db", "oracle database"]),
        "sql server": ("relational_database", ["mssql", "microsoft sql server"]),
    },
    "cloud_platforms": {
        "aws": ("cloud_platform", ["amazon web services", "ec2", "s3", "lambda", "rds"]),
        "azure": ("cloud_platform", ["microsoft azure", "azure cloud"]),
        "gcp": ("cloud_platform", ["google cloud", "google cloud platform"]),
        "digital ocean": ("cloud_platform", ["digitalocean", "do"]),
    },
    "tools_and_platforms": {
        "docker": ("containerization", ["containerization", "docker compose"]),
        "kubernetes": ("orchestration", ["k8s", "k8", "container orchestration"]),
        "git": ("version_control", ["github", "gitlab", "bitbucket", "version control"]),
        "jenkins": ("ci_cd", ["ci/cd", "continuous integration"]),
        "terraform": ("infrastructure", ["infrastructure as code", "iac"]),
        "ansible": ("automation", ["configuration management"]),
    },
    "mobile_technologies": {
        "react native": ("mobile_framework", ["reactnative", "rn"]),
        "flutter": ("mobile_framework", ["dart flutter"]),
        "ionic": ("mobile_framework", ["ionic framework"]),
        "xamarin": ("mobile_framework", ["xamarin.forms"]),
        "android": ("mobile_platform", ["android studio", "android development"]),
        "ios": ("mobile_platform", ["xcode", "ios development", "iphone"]),
    },
    "data_science": {
        "machine learning": ("ai_ml", ["ml", "artificial intelligence", "ai"]),
        "tensorflow": ("ml_framework", ["tf", "keras"]),
        "pytorch": ("ml_framework", ["torch"]),
        "pandas": ("data_analysis", ["data manipulation"]),
        "numpy": ("data_analysis", ["numerical computing"]),
        "scikit-learn": ("ml_library", ["sklearn", "scikit learn"]),
        "tableau": ("data_visualization", ["data visualization"]),
        "power bi": ("data_visualization", ["powerbi", "microsoft power bi"]),
        "spark": ("big_data", ["apache spark", "pyspark"]),
        "hadoop": ("big_data", ["apache hadoop", "hdfs"]),
    },
}

VIETNAMESE_KEYWORDS = {
    "seniority_levels": {
        "fresher": ("entry_level", ["fresh graduate", "entry level", "new graduate", "intern", "internship", "thực tập"]),
        "junior": ("junior_level", ["jr", "junior developer", "junior engineer", "nhân viên", "0-2 years", "1-2 years"]),
        "middle": ("middle_level", ["mid", "mid-level", "intermediate", "2-5 years", "3-5 years", "nhân viên chính"]),
        "senior": ("senior_level", ["sr", "senior developer", "senior engineer", "chuyên viên", "5+ years", "expert"]),
        "lead": ("leadership", ["team lead", "technical lead", "tech lead", "lead developer", "trưởng nhóm", "leader"]),
        "manager": ("management", ["engineering manager", "development manager", "project manager", "quản lý", "pm"]),
        "architect": ("architecture", ["solution architect", "system architect", "software architect", "kiến trúc sư"]),
        "director": ("executive", ["engineering director", "technical director", "giám đốc kỹ thuật"]),
    },
    "vietnamese_skills": {
        "lập trình": ("programming_vn", ["programming", "code", "coding", "viết code"]),
        "phát triển web": ("web_development_vn", ["web development", "web dev", "phát triển website"]),
        "phát triển mobile": ("mobile_development_vn", ["mobile development", "mobile dev", "ứng dụng di động"]),
        "cơ sở dữ liệu": ("database_vn", ["database", "db", "sql", "csdl"]),
        "trí tuệ nhân tạo": ("ai_vn", ["artificial intelligence", "ai", "machine learning", "ml", "học máy"]),
        "phân tích dữ liệu": ("data_analysis_vn", ["data analysis", "data analytics", "phân tích số liệu"]),
        "kiểm thử": ("testing_vn", ["testing", "qa", "quality assurance", "test"]),
        "devops": ("devops_vn", ["deployment", "ci/cd", "triển khai", "vận hành"]),
    },
    "vietnamese_job_types": {
        "toàn thời gian": ("employment_type_vn", ["full-time", "fulltime", "full time", "chính thức"]),
        "bán thời gian": ("employment_type_vn", ["part-time", "parttime", "part time"]),
        "thực tập": ("employment_type_vn", ["internship", "intern", "thực tập sinh"]),
        "freelance": ("employment_type_vn", ["tự do", "làm tự do", "contract", "hợp đồng"]),
        "remote": ("work_arrangement_vn", ["làm từ xa", "work from home", "wfh", "online"]),
        "onsite": ("work_arrangement_vn", ["tại văn phòng", "office", "làm tại chỗ"]),
        "hybrid": ("work_arrangement_vn", ["kết hợp", "mixed", "linh hoạt"]),
    },
    "vietnamese_benefits": {
        "lương cạnh tranh": ("compensation_vn", ["competitive salary", "mức lương hấp dẫn", "thu nhập cao"]),
        "bảo hiểm": ("benefits_vn", ["insurance", "bảo hiểm y tế", "health insurance"]),
        "thưởng": ("benefits_vn", ["bonus", "performance bonus", "thưởng hiệu suất"]),
        "đào tạo": ("benefits_vn", ["training", "phát triển kỹ năng", "học tập"]),
        "nghỉ phép": ("benefits_vn", ["vacation", "annual leave", "paid leave", "nghỉ có lương"]),
        "môi trường trẻ": ("culture_vn", ["young environment", "dynamic", "năng động"]),
    },
    "vietnamese_requirements": {
        "kinh nghiệm": ("requirements_vn", ["experience", "exp", "năm kinh nghiệm"]),
        "bằng cấp": ("education_vn", ["degree", "diploma", "học vấn", "tốt nghiệp"]),
        "tiếng anh": ("language_vn", ["english", "english skills", "khả năng tiếng anh"]),
        "kỹ năng giao tiếp": ("soft_skills_vn", ["communication skills", "communication", "giao tiếp"]),
        "làm việc nhóm": ("soft_skills_vn", ["teamwork", "team work", "hợp tác"]),
        "giải quyết vấn đề": ("soft_skills_vn", ["problem solving", "problem-solving", "tư duy logic"]),
    },
}
SOFT_SKILLS = {
    "soft_skills": {
        "leadership": ("management", ["team leadership"]),
        "communication": ("interpersonal", ["communication skills"]),
        "teamwork": ("interpersonal", ["team work", "collaboration"]),
        "problem solving": ("analytical", ["problem-solving"]),
        "critical thinking": ("analytical", []),
        "project management": ("management", []),
        "time management": ("organization", []),
        "adaptability": ("personal", ["flexibility"]),
        "creativity": ("personal", ["innovative thinking"]),
        "analytical thinking": ("analytical", []),
    },
}

INDUSTRY_TERMS = {
    "methodologies": {
        "agile": ("methodology", ["agile development"]),
        "scrum": ("methodology", []),
        "kanban": ("methodology", []),
        "waterfall": ("methodology", []),
        "devops": ("methodology", ["dev ops"]),
        "ci/cd": ("methodology", ["continuous integration", "continuous deployment"]),
    },
    "roles": {
        "full stack developer": ("role", ["fullstack developer"]),
        "frontend developer": ("role", ["front-end developer"]),
        "backend developer": ("role", ["back-end developer"]),
        "data scientist": ("role", []),
        "machine learning engineer": ("role", ["ml engineer"]),
        "devops engineer": ("role", []),
        "product manager": ("role", ["pm"]),
        "software architect": ("role", []),
    },
}

# Smaller skill and technology dictionaries, used when no full one is configured.
COMPACT_SKILLS = {
    "programming_languages": {
        "python": ("programming", ["py"]),
        "java": ("programming", []),
        "javascript": ("programming", ["js", "node.js", "nodejs"]),
        "typescript": ("programming", ["ts"]),
        "c++": ("programming", ["cpp", "c plus plus"]),
        "c#": ("programming", ["csharp", "c sharp"]),
        "php": ("programming", []),
        "ruby": ("programming", []),
        "go": ("programming", ["golang"]),
        "rust": ("programming", []),
        "swift": ("programming", []),
        "kotlin": ("programming", []),
        "scala": ("programming", []),
        "r": ("programming", []),
        "matlab": ("programming", []),
        "sql": ("database", ["structured query language"]),
    },
    "data_science": {
        "machine learning": ("ai", ["ml", "machinelearning"]),
        "deep learning": ("ai", ["dl", "neural networks"]),
        "artificial intelligence": ("ai", ["ai"]),
        "natural language processing": ("ai", ["nlp"]),
        "computer vision": ("ai", ["cv"]),
        "data analysis": ("analysis", ["data analytics"]),
        "statistics": ("analysis", ["statistical analysis"]),
        "big data": ("data", []),
        "data mining": ("data", []),
        "predictive modeling": ("modeling", []),
    },
}

COMPACT_TECHNOLOGIES = {
    "frameworks": {
        "react": ("frontend", ["reactjs", "react.js"]),
        "angular": ("frontend", ["angularjs"]),
        "vue": ("frontend", ["vuejs", "vue.js"]),
        "django": ("backend", []),
        "flask": ("backend", []),
        "spring": ("backend", ["spring boot"]),
        "express": ("backend", ["expressjs", "express.js"]),
        "laravel": ("backend", []),
        "rails": ("backend", ["ruby on rails"]),
    },
    "databases": {
        "mysql": ("database", []),
        "postgresql": ("database", ["postgres"]),
        "mongodb": ("database", ["mongo"]),
        "redis": ("database", []),
        "elasticsearch": ("database", ["elastic search"]),
        "cassandra": ("database", []),
        "oracle": ("database", []),
        "sqlite": ("database", []),
    },
    "cloud_platforms": {
        "aws": ("cloud", ["amazon web services"]),
        "azure": ("cloud", ["microsoft azure"]),
        "gcp": ("cloud", ["google cloud platform", "google cloud"]),
        "docker": ("containerization", []),
        "kubernetes": ("containerization", ["k8s"]),
        "terraform": ("infrastructure", []),
    },
}

# The six dictionaries by the name their matches are reported under.
DICTIONARIES = {
    "skills": SKILLS,
    "technologies": TECHNOLOGIES,
    "soft_skills": SOFT_SKILLS,
    "industry_terms": INDUSTRY_TERMS,
    "vietnamese_keywords": VIETNAMESE_KEYWORDS,
    "extended_technologies": EXTENDED_TECHNOLOGIES,
}
COMPACT_DICTIONARIES = {
    **DICTIONARIES,
    "skills": COMPACT_SKILLS,
    "technologies": COMPACT_TECHNOLOGIES,
}


class Term(NamedTuple):
    """One surface form of a dictionary term; ``alias_pos`` 0 is the term itself."""

    dict: str
    category: str
    subcategory: str
    term: str
    weight: float
    alias: str
    alias_pos: int


def flatten(dictionaries: dict[str, dict]) -> list[Term]:
    """All surface forms of the given dictionaries, terms first, aliases in list order."""
    return [
        Term(name, category, subcategory, term, TERM_WEIGHT, form, pos)
        for name, groups in dictionaries.items()
        for category, terms in groups.items()
        for term, (subcategory, aliases) in terms.items()
        for pos, form in enumerate([term, *aliases])
    ]
