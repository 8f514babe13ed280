"""Print the query names registered by one workload module, comma separated."""

import re
import sys

text = open(sys.argv[1]).read()
print(",".join(re.findall(r'query\(\s*\n?\s*f?"(\w+)"', text)))
