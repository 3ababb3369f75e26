"""What kinds of words a file holds, as bits of one number, found once and used to choose files
before any rule runs on their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of each flag; a flag's bit is its place.
WORDS = {
    "file_ops": ("open(", "unlink", "rmdir", "mkdir", "copyFile", "rename(", "readFile", "writeFile", "shutil", "os.remove", "createReadStream", "createWriteStream", "sendFile", "send_file", "serve_file", "appendFile", "statSync", "accessSync"),
    "path_ops": ("path.join", "path.resolve", "os.path", "filepath", "pathlib"),
    "sql": ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", "CREATE ", "DROP ", "select ", "insert ", "execute("),
    "import": ("import ", "require(", "from "),
    "eval": ("eval(", "exec(", "Function("),
    "http_client": ("requests.", "fetch(", "axios", "urllib", "http.get", "http.post", "HttpClient", "ureq", "reqwest"),
    "user_input": ("request.", "req.body", "req.query", "req.params", "request.GET", "request.POST", "input(", "sys.argv", "process.argv"),
    "crypto": ("hashlib", "crypto", "md5", "sha1", "DES", "AES", "cipher", "encrypt", "decrypt"),
    "template": ("render(", "template", "jinja", "Markup(", "innerHTML"),
    "serialize": ("pickle", "marshal", "yaml.load", "json.loads", "deserialize", "ObjectInputStream", "readObject", "XMLDecoder"),
    "exec": ("os.system", "subprocess", "child_process", "popen"),
    "secret": ("password", "secret", "api_key", "token", "private_key", "BEGIN RSA"),
    "ml": ("torch", "numpy", "tensorflow", "sklearn", "pandas"),
    "react": ("useState", "useEffect", "React", "react"),
    "django": ("django", "Django"),
    "express": ("express", "app.get(", "app.post(", "router."),
}
BIT = {name: 1 << i for i, name in enumerate(WORDS)}


def flags(content: Column) -> Column:
    """The sum of the bits of all flags that a text has a word of."""
    parts = [F.when(reduce(lambda a, b: a | b, (F.contains(content, F.lit(w)) for w in words)), BIT[name]).otherwise(0) for name, words in WORDS.items()]
    return reduce(lambda a, b: a + b, parts).cast("int")


def file_index(files: DataFrame) -> DataFrame:
    """path, extension, flags of files (path, content)."""
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("extension"), flags(F.col("content")).alias("flags"))


def matching(index: DataFrame, extensions: list[str], *wanted: str) -> DataFrame:
    """Files of one of the extensions with one of the flags (any file if none is named)."""
    mask = sum(BIT[w] for w in wanted)
    found = index.where(F.lower("extension").isin(*extensions))
    return found.where(F.col("flags").bitwiseAND(F.lit(mask)) != 0) if wanted else found
