"""Built-in seed URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The seed lists, in order, whose hashes identify a run.
SMALL = (
    "http://example.com",
    "http://example.org",
    "https://www.python.org/",
    "https://www.gnu.org/",
    "https://www.wikipedia.org/",
    "https://github.com/",
    "https://stackoverflow.com/",
    "https://www.bbc.com/",
)
LARGE = (
    "http://example.com",
    "http://example.org",
    "https://www.iana.org/",
    "https://www.wikipedia.org/",
    "https://en.wikipedia.org/wiki/Main_Page",
    "https://www.gnu.org/",
    "https://www.kernel.org/",
    "https://www.python.org/",
    "https://docs.python.org/3/",
    "https://www.openbsd.org/",
    "https://www.freebsd.org/",
    "https://www.debian.org/",
    "https://ubuntu.com/",
    "https://archlinux.org/",
    "https://www.linux.org/",
    "https://www.rust-lang.org/",
    "https://doc.rust-lang.org/",
    "https://go.dev/",
    "https://pkg.go.dev/",
    "https://nodejs.org/",
    "https://www.java.com/",
    "https://openjdk.org/",
    "https://www.postgresql.org/",
    "https://www.mysql.com/",
    "https://sqlite.org/",
    "https://redis.io/",
    "https://www.mongodb.com/",
    "https://www.nginx.com/",
    "https://httpd.apache.org/",
    "https://www.cloudflare.com/",
    "https://www.mozilla.org/",
    "https://developer.mozilla.org/",
    "https://www.w3.org/",
    "https://www.w3schools.com/",
    "https://www.ibm.com/",
    "https://www.oracle.com/",
    "https://www.intel.com/",
    "https://www.nvidia.com/",
    "https://www.amd.com/",
    "https://www.microsoft.com/",
    "https://learn.microsoft.com/",
    "https://github.com/",
    "https://docs.github.com/",
    "https://git-scm.com/",
    "https://about.gitlab.com/",
    "https://stackoverflow.com/",
    "https://serverfault.com/",
    "https://superuser.com/",
    "https://www.reddit.com/",
    "https://news.ycombinator.com/",
    "https://www.bbc.com/",
    "https://www.cnn.com/",
    "https://www.reuters.com/",
    "https://www.nytimes.com/",
    "https://www.theguardian.com/",
    "https://www.aljazeera.com/",
    "https://www.economist.com/",
    "https://www.nasa.gov/",
    "https://www.noaa.gov/",
    "https://www.nist.gov/",
    "https://www.who.int/",
    "https://www.un.org/",
    "https://www.worldbank.org/",
    "https://www.imf.org/",
    "https://www.oecd.org/",
    "https://www.cern.ch/",
    "https://home.cern/",
    "https://arxiv.org/",
    "https://www.nature.com/",
    "https://www.science.org/",
    "https://www.springer.com/",
    "https://www.elsevier.com/",
    "https://www.acm.org/",
    "https://www.ieee.org/",
    "https://www.kaggle.com/",
    "https://www.tensorflow.org/",
    "https://pytorch.org/",
    "https://scikit-learn.org/",
    "https://numpy.org/",
    "https://pandas.pydata.org/",
    "https://matplotlib.org/",
    "https://plotly.com/",
    "https://jupyter.org/",
    "https://www.anaconda.com/",
    "https://www.docker.com/",
    "https://kubernetes.io/",
    "https://helm.sh/",
    "https://prometheus.io/",
    "https://grafana.com/",
    "https://www.jenkins.io/",
    "https://circleci.com/",
    "https://www.travis-ci.com/",
    "https://www.netlify.com/",
    "https://vercel.com/",
    "https://www.heroku.com/",
    "https://aws.amazon.com/",
    "https://cloud.google.com/",
    "https://azure.microsoft.com/",
    "https://www.digitalocean.com/",
    "https://www.linode.com/",
    "https://www.cloudflarestatus.com/",
    "https://status.github.com/",
    "https://www.wikipedia.org/wiki/Computer_science",
    "https://www.wikipedia.org/wiki/Web_crawler",
    "https://www.wikipedia.org/wiki/PageRank",
)
SECOND_PHASE = (
    "https://www.rust-lang.org/",
    "https://www.w3.org/",
    "https://www.nasa.gov/",
    "https://nodejs.org/",
    "https://www.docker.com/",
)
PROFILES = {"small": SMALL, "large": LARGE, "second_phase": SECOND_PHASE}


def seeds(spark: SparkSession, profile: str = "small") -> DataFrame:
    """seq, url of a built-in list."""
    return spark.createDataFrame(list(enumerate(PROFILES[profile])), "seq long, url string")
