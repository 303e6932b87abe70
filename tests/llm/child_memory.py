"""Whether a process that a JVM starts counts the JVM's memory again for an instant: samples the children of a Spark JVM that writes to a local folder."""
import re, sys, threading, time, os
from pathlib import Path
import psutil
from pyspark.sql import SparkSession
spark=SparkSession.builder.master("local[4]").config("spark.ui.enabled","false").config("spark.driver.memory","2g").config("spark.driver.extraJavaOptions","-Xms1500m -XX:+AlwaysPreTouch").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def pss(pid): return sum(map(int,re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)",Path(f"/proc/{pid}/smaps_rollup").read_text())))/1024
jvm=next(p for p in psutil.Process().children(recursive=True) if "SparkSubmit" in " ".join(p.cmdline()))
seen=[];stop=False;n=0
def watch():
    global n
    while not stop:
        n+=1
        for t in Path(f"/proc/{jvm.pid}/task").iterdir():
            try: kids=(t/"children").read_text().split()
            except OSError: continue
            for k in kids:
                try: seen.append((round(pss(k)), Path(f"/proc/{k}/cmdline").read_bytes()[-40:]))
                except OSError: pass
th=threading.Thread(target=watch); th.start()
t=time.time(); i=0
while time.time()-t<35:
    spark.range(0,4000,1,40).write.mode("overwrite").parquet("file:///tmp/child-memory"); i+=1
stop=True; th.join()
print("jvm",round(pss(jvm.pid)),"writes",i,"samples",n,"children seen",len(seen),"large",len([s for s in seen if s[0]>500]))
print(sorted(seen,key=lambda s:-s[0])[:5]); print(seen[:5])
spark.stop()
